"""Seed words of the languages, from which labelled training sentences are found in the data."""

from __future__ import annotations

# Frequent function words and common phrases of each language; what two languages share is left out.
SEED_WORDS = {
    "rw": """na ya wa za la cha vya ni sana ariko kandi cyangwa kuko kugira ngo mu ku wa ya rya cya bya byo cyo kwa muri kuri iyi iki ibi uyu aba ese
        ni nta nubwo hanyuma maze yari ubwo ejo uwo munsi saa nk nyuma mbere hamwe hagati hafi iri ijambo interuro
        risobanura numvise avuga byo murakoze mwaramutse muraho yego oya ndabyumva sinabyumvise neza ndashaka kwiga
        byinshi kurushaho ongera ubisobanure nyabuneka amakuru umwana umwarimu abana abantu abanyeshuri umunyeshuri
        umugabo umugore umuntu ihangane mumbabarire sinshobora ntabwo sinzi andika soma sobanura tanga hindura kosora
        wabaza gusubiza urakoze bose cyane buhoro kugufasha byerekeye mwirirwe muramuke ikinyarwanda kuvuga iyo""",
    "en": """the and of to in that is was for with are this but not you have from they which one were all there when
        been has more who will would can what how should before after because although without while then had it at
        by an or be as his her she he we our your my i thank very much good really again please explain understand
        want learn hello yes no sorry unable cannot write read say said did does do use used first another between
        until since so could may on if about into these those their them us me its any some only than also once""",
    "fr": """le la les des une un et est dans pour que qui avec sur pas plus par au aux du ce cette ces mais ou où
        donc il elle nous vous ils elles je tu mon ma mes ton son sa ses leur leurs être avoir fait été sont était
        avant après sans pendant parce bien comme chez quand merci beaucoup bonjour oui non veux apprendre davantage
        expliquez encore plaît comprends compris désolé malheureusement impossible répondre peux puis juste vu
        écrit veut dire quel quelle quels pourquoi comment très aussi tout tous toute même en y ne se me te lui""",
    "sw": """ya wa za la cha vya kwa na ni katika kwenye kama lakini au hii hiyo huyo huu hizi hao yeye mimi wewe sisi
        baada kabla wakati karibu kando nyuma bila ingawa ili kwamba hakuna sana asante ndiyo hapana naelewa sijaelewa
        vizuri nataka kujifunza zaidi tafadhali eleza tena habari yako neno lina maana gani niliona limeandikwa je
        sahihi samahani siwezi kusaidia alikuwa alisema jioni asubuhi jana leo kesho mwezi wiki mwalimu mwanafunzi
        mtoto rafiki yangu jirani yetu hutumika mwaka somo kuhusu kujibu pole bwana bibi watu""",
}

# Short texts of everyday use, added to the training sentences so that no language starts from nothing.
SEED_TEXTS = {
    "rw": [
        "Murakoze ku mfashanyo mwaduhaye.", "Mwaramutse mwese, mwicare.", "Yego, ibyo ndabizi kuva kera.", "Ibyo uvuze ntabwo byumvikana.", "Twifuza kwiga indimi nyinshi muri uyu mwaka.",
        "Subiramo ayo magambo gahoro gahoro.", "Uyu munsi ikirere kimeze neza.", "Muraho neza, amakuru yawe?", "Ni meza, urakoze.", "Wihangane, nta mwanya mfite ubu.",
        "Umwana agiye ku ishuri buri gitondo.", "Abantu benshi bakunda gusoma ibitabo.", "Ejo tuzajya ku isoko kugura imbuto.",
        "Iki gitabo ni icya nde?", "Reka twige ururimi rw'ikinyarwanda.", "Ntabwo nzi igisubizo cy'iki kibazo.", "Nyakubahwa, murebe niba urugi rufunze.",
    ],
    "en": [
        "We are grateful for the help you gave us.", "Good evening to all of you.", "Right, that has been known for a long time.", "I did not understand well.", "We would like to study several languages this year.",
        "Repeat these words slowly.", "The weather is fine today.", "Hello, how are you today?", "I am fine, thanks.", "Forgive me, there is no time for it now.",
        "The child goes to school every morning.", "Many people like to read books.", "Tomorrow we will go to the market to buy fruit.",
        "Whose book is this?", "Let us learn the language together.", "I do not know the answer to this question.", "Please check whether the door is locked.",
    ],
    "fr": [
        "Nous vous remercions de votre aide.", "Bonjour, monsieur le professeur.", "Oui, on le sait depuis longtemps.", "Ce que vous dites n'est pas clair.", "Nous voulons étudier plusieurs langues cette année.",
        "Répétez ces mots lentement.", "Il fait beau aujourd'hui.", "Bonjour, comment allez-vous aujourd'hui ?", "Je vais bien, merci.", "Excusez-moi, je n'ai pas le temps maintenant.",
        "L'enfant va à l'école chaque matin.", "Beaucoup de gens aiment lire des livres.", "Demain nous irons au marché acheter des fruits.",
        "À qui est ce livre ?", "Apprenons la langue ensemble.", "Je ne connais pas la réponse à cette question.", "À demain, bonne journée !",
    ],
    "sw": [
        "Tunakushukuru kwa msaada wako.", "Habari za jioni, wanafunzi wote.", "Ndiyo, jambo hilo linajulikana tangu zamani.", "Unachosema hakieleweki.", "Tungependa kujifunza lugha nyingi mwaka huu.",
        "Rudia maneno haya polepole.", "Hali ya hewa ni nzuri leo.", "Habari, hujambo leo?", "Sijambo, asante.", "Samahani, sina nafasi sasa.",
        "Mtoto huenda shuleni kila asubuhi.", "Watu wengi wanapenda kusoma vitabu.", "Kesho tutakwenda sokoni kununua matunda.",
        "Kitabu hiki ni cha nani?", "Tujifunze lugha pamoja.", "Sijui jibu la swali hili.", "Kwaheri, tutaonana kesho!",
    ],
}

#: How a language is named in a label, after case and outer spaces are removed.
LABELS = {
    "rw": ("rw", "rw-rw", "rw_rw", "kin", "kinyarwanda", "ikinyarwanda", "rwa"),
    "en": ("en", "en-us", "en-gb", "en_us", "en_gb", "eng", "english", "icyongereza", "anglais"),
    "fr": ("fr", "fr-fr", "fr_fr", "fra", "fre", "french", "français", "francais", "igifaransa"),
    "sw": ("sw", "sw-ke", "sw-tz", "sw_ke", "sw_tz", "swa", "swh", "swahili", "kiswahili", "igiswahili"),
}
#: Labels that name no language.
NO_LABEL = ("", "auto", "unknown", "und", "none", "null", "n/a", "na", "-", "?", "tbd", "mul", "other", "detect", "xx", "zxx")
