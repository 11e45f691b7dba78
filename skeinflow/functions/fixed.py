"""Word lists, lookup tables, constants and patterns that results depend on.

Tables of more than some two hundred entries (phrases by event type, surface
forms of places, outlets, feeds) are not here: they come as parameters.
"""

# Names of tracking parameters of a url, as prefixes and whole names.
TRACKING_PREFIXES = ("utm_", "fbclid", "gclid", "mc_")
TRACKING_NAMES = ("ref",)

# How a text that is only a wall begins.
PAYWALL = (
    "you are not logged in", "subscribe to read", "please log in", "log in to read", "this content is for subscribers",
    "subscribers only", "sign in to continue", "the topic tool shows you", "case law discussion for 3000+ topics", "become a subscriber",
)

# Words that tell nothing about a headline.
STOP = tuple(
    "the a an of to in on for and or with by from at as is are was were be has have had its their this that over under against into "
    "after before amid says said new will could may how why who what when icsid case registered arb republic kingdom state states united".split()
)
SUFFIX = "(ments?|ations?|ings?|ies|es|ed|s)$"
SHORT_WORDS = ("eu", "us", "uk", "un")
ALIASES = {
    "kremlin": "russia", "moscow": "russia", "putin": "russia", "beijing": "china", "ankara": "turkey", "erdogan": "turkey",
    "washington": "united", "kyiv": "ukraine", "tehran": "iran", "riyadh": "saudi",
}
# Words of the trade, which pair up in any headline.
GENERIC = tuple(
    "court courts high supreme appeal appeals tribunal arbitral arbitration award awards judge judges ruling rules dispute disputes claim "
    "claims relief interim injunction case cases bench division commercial grants granted order orders decision holds held enforcement enforce "
    "set aside annul annulment application petition hearing judgment judgments international investor investors treaty state government ministry "
    "minister law legal firm partner partners".split()
)
# Stop words of the second list of stems (first five letters).
STEM5_STOP = tuple(
    "about after against amid before between court from over says said that their there these this under what when which while with would your "
    "into than them then they were will have been being more most".split()
)
# Words of offers and prompts that are no prose about a subject.
PROMO = (
    r"subscribe|sign up|newsletter|cookie|click here|read more|topic tool|3000\+ topics|log in|register to|free trial|all rights reserved|"
    "terms of use|privacy policy"
)

# Half-life in days, factor of each source tier, and what scores are made of.
HALF_LIFE = 6.0
TIER_FACTOR = {1: 1.15, 2: 1.0, 3: 0.85}
UNDATED_AGE = 3.0
CLAIMANT_BOOST, TRADE_BASE, AMOUNT_CAP, VACANCY, FOREIGN, MUTED = 0.5, 60.0, 20.0, 12.0, 0.55, 0.25
VACANCY_EVENTS = ("notice_of_intent", "new_case_filed", "s1782_application", "enforcement_action", "distress_event")
MEASURE_EVENTS = ("state_measure", "distress_event")
# Weights of event types that the operators name; further types come with the parameter.
STAGES = {
    "award": ("award_issued", "enforcement_action", "annulment_setaside"),
    "filing": ("new_case_filed", "notice_of_intent"),
    "measure": ("state_measure", "distress_event"),
}
LEAD_EVENTS = (
    "state_measure", "distress_event", "notice_of_intent", "counsel_tender", "commercial_dispute", "interim_relief", "funding", "counsel_change",
    "settlement", "s1782_application",
)
ENFORCEMENT_EVENTS = ("enforcement_action", "s1782_application", "annulment_setaside")
PEOPLE_EVENTS = ("lateral_move", "appointment", "counsel_instructed", "counsel_change")

# Sides of an appointment, by the first key that its label holds.
SIDES = (
    ("claimant", "claimant"), ("respondent", "respondent"), ("parties", "parties"), ("chairman", "chairman"),
    ("administrative council", "chairman"), ("tribunal", "tribunal"),
)

# Measures against investors, as patterns of a headline.
MEASURES = (
    ("windfall tax", "windfall[ -](?:tax|profit|charge|levy)"),
    ("nationalisation", "nationali[sz]"),
    ("expropriation", "expropriat"),
    ("licence revoked", r"licen[cs]e\w*.{0,40}\b(?:revok|suspend|cancel|withdr|strip)|(?:revok|suspend|cancel|withdr|strip)\w*.{0,40}licen[cs]e"),
    ("price cap", "price caps?|caps? (?:on )?(?:fuel|energy|electricity|gas|margin)|margin caps?"),
    ("export ban", "export (?:ban|curb|restriction|halt)|bans? (?:the )?exports?"),
    ("concession terminated", r"concession\w*.{0,40}\b(?:terminat|cancel|revok|annul)|(?:terminat|cancel|revok|annul)\w*.{0,40}concession"),
    ("moratorium", "moratori"),
    ("mining halt", "mining (?:ban|halt|suspen|permit)"),
    ("asset seizure", r"seiz\w*.{0,30}\b(?:asset|plant|refiner|mine|stake|shares)|(?:asset|plant|refiner|mine|stake|shares)\w*.{0,30}\bseiz"),
)
REGION = r"\b(?:EU|E\.U\.|European Union|Europe|Brussels|Eurogroup|European Commission|eurozone)\b"

# Function words by language, in the order in which a tie is decided.
LANGUAGE_WORDS = {
    "es": "el la de las en los por para con una del que se su al es lo más como sus ha sobre",
    "fr": "le la les des du une pour dans sur avec est qui que au aux ce cette par ne pas plus été",
    "de": "der die das und den dem mit für von ist nicht eine ein auf sich des zu im hat wird auch",
    "pt": "o a e os as de do da dos das em para com uma não que é ao pelo pela foi são mais sua seu",
    "it": "il di che per con del della una un non sono gli le nel alla dei ha più anche stato",
    "nl": "het een van en op met voor dat zijn niet aan ook door bij naar heeft worden werd",
    "tr": "ve bir bu için ile olarak olan tarafından gibi daha en da de ancak sonra karşı",
    "pl": "się nie jest że przez dla od po jako oraz który została został",
    "id": "dan yang di untuk dengan dari ini itu pada akan telah tidak oleh dalam",
    "en": "the and of to in is for on with that by as has its from was were been are will",
}
# Scripts that give a language away, as ranges of characters.
SCRIPTS = (
    ("\\x{0600}-\\x{06FF}", "ar"), ("\\x{0530}-\\x{058F}", "hy"), ("\\x{10A0}-\\x{10FF}", "ka"), ("\\x{0590}-\\x{05FF}", "he"),
    ("\\x{4E00}-\\x{9FFF}", "zh"), ("\\x{3040}-\\x{30FF}", "ja"), ("\\x{AC00}-\\x{D7A3}", "ko"), ("\\x{0E00}-\\x{0E7F}", "th"),
)

# Sentences end before a capital or an opening quote.
SENTENCE = "(?<=[.!?])\\s+(?=[A-Z“‘(])"
SENTENCE_ENDS = ".!?”’\")"
GROUND_SHARE, GROUND_SHORT = 0.7, 3
# Thresholds of the story rules.
JACCARD_ALONE, JACCARD_THREE, JACCARD_KIND = 0.5, 0.22, 0.15

# Caps of a headline and of an explanation, in words and characters.
HEADLINE_WORDS, EXPLANATION_WORDS, EXPLANATION_CHARS = 14, 36, 230

# House forms, as pattern and replacement in the order in which they apply; amounts come first.
AMOUNTS = (
    (r"(?<![A-Za-z$])\$\s?(\d[\d,.]*)\s?(?:billion|bn|B)\b", r"US\$$1 billion"),
    (r"(?<![A-Za-z$])\$\s?(\d[\d,.]*)\s?(?:million|mn|M)\b", r"US\$$1 million"),
    (r"(?<![A-Za-z$])\$\s?(\d[\d,.]*)(?![\d,.])", r"US\$$1"),
    (r"(?i)\bUSD\s?(\d[\d,.]*)\s?(?:billion|bn)\b", r"US\$$1 billion"),
    (r"(?i)\bUSD\s?(\d[\d,.]*)\s?(?:million|mn)\b", r"US\$$1 million"),
    (r"(?i)\bUSD\s?(\d[\d,.]*)", r"US\$$1"),
    (r"\bEUR\s?(\d[\d,.]*)", "€$1"),
    (r"\bGBP\s?(\d[\d,.]*)", "£$1"),
    (r"(US\$|€|£)(\d[\d,.]*)\s?M\b", "$1$2 million"),
    (r"(US\$|€|£)(\d[\d,.]*)\s?bn\b", "$1$2 billion"),
)
SPELLING = (
    (r"(?i)\b(a|the|its|their|his|her|operating|mining|banking|electronic-money|e-money|payments?) license(s?)\b", "$1 licence$2"),
    (r"(?i)\blicense (revoked|suspended|cancelled|canceled|withdrawn)\b", "licence $1"),
    (r"(?i)\bdefense\b", "defence"),
    (r"\bfavor(s|ed|able|ite)?\b", "favour$1"),
    (r"\bcenter(s)?\b", "centre$1"),
    (r"\borganization(s)?\b", "organisation$1"),
    (r"\brecogniz(e|es|ed|ing|ition)\b", "recognis$1"),
    (r"\banalyz(e|es|ed|ing)\b", "analys$1"),
    (r"\blabor\b", "labour"),
    (r"\bhonor(s|ed)?\b", "honour$1"),
    (r"\bcanceled\b", "cancelled"),
)
# Words that an explanation does without.
BANNED = (
    r"(?i)\b(notably|crucially|importantly|landscape|navigate|delve|robust|leverage|game-?changer|unpack|underscores?|highlights? the importance|"
    r"a testament to|moving forward|at the end of the day|it is worth noting|in today'?s|this development|significant(?:ly)?|landmark|pivotal|"
    r"stakeholders?|synerg\w+|paradigm)\b"
)
# What stands around a feed's text.
DATELINE = (
    r"^(?:[A-Z][A-Z .'’-]{2,30}|[A-Z][a-z]+(?: [A-Z][a-z]+)?)(?:,\s*[A-Z][a-z]{2,8}\.?\s+\d{1,2}(?:,\s*\d{4})?)?\s*"
    r"(?:\((?:Reuters|AP|AFP|Bloomberg|Xinhua|dpa|PTI|ANI)\))?\s*[—–:-]\s+(?=[A-Z])"
)
BYLINE = r"(?s)^(.{0,160}?)\s*\bBy [A-Z][\w.'’-]+(?: [A-Z][\w.'’-]+){0,3}(?:,\s*[A-Z][a-z]+)?\s*"
TRAILERS = (
    r"(?s)\s*(?:The post .{0,200}? appeared first on .{0,80}?(?:\.|$)|Read more.{0,40}$|Continue reading.{0,40}$|"
    r"The article .{0,120} first appeared on .{0,60}\.?$)"
)
HEAD_PREFIX = r"(?i)^(?:BREAKING|UPDATE|UPDATED|EXCLUSIVE|WATCH|VIDEO|OPINION|ANALYSIS)\s*[:–—-]\s*"
HEAD_SUFFIX = r"\s+[|–—-]\s+[A-Z][\w .&'-]{2,40}$|\s*\((?:Reuters|Bloomberg|AP|AFP)\)\s*$"
# Nouns that belong to the name before them.
INSTITUTION_NOUNS = tuple(
    "court courts tribunal bank ministry authority commission council chamber centre center institute association corporation board agency "
    "university group high supreme federal".split()
)
# Words at which a trailing phrase opens, and words that don't end a sentence.
PHRASE_OPENERS = tuple(
    "of in on at to for by with from as that which who over under after before during about against between through while amid into than and or "
    "but because since until unless whether when where if following despite including without within via per".split()
)
FUNCTION_WORDS = tuple(
    "a an the of in on at to for and or but by with from as that which who whom is are was were has have had been be its their his her than into "
    "over under after before during about against between through while amid per via not no nor so if when where will would can could may might "
    "shall should this these those such also both either another other any some each every all most several many using including without within "
    "because since until unless whether what how why then yet just".split()
)

# What names a business in a text; cabinets are none.
BUSINESS = (
    r"\b(?:Inc|Ltd|Limited|Plc|LLC|LLP|GmbH|AG|SA|SpA|NV|BV|Pty|Corp|Corporation|Holdings|Group|"
    r"Co\b|Company|Industries|Energy|Mining|Resources|Petroleum|Oil|Gas|Power|Bank|Telecom|Airlines|"
    r"Airways|Cement|Steel|Motors|Pharma|Capital|Partners|Ventures)\b(?!\s+of\s+Ministers)"
)

# What shows a foreign or sovereign side in a docket's text in lower case.
FOREIGN_WORDS = "foreign|republic of|kingdom of|federation|international|new york convention|1782"

# How courts are cited, by their place in the address of a judgment.
COURT_CODES = {
    "uksc": "UKSC", "ukpc": "UKPC", "ewca/civ": "EWCA Civ", "ewca/crim": "EWCA Crim",
    "ewhc/comm": "EWHC (Comm)", "ewhc/tcc": "EWHC (TCC)", "ewhc/ch": "EWHC (Ch)", "ewhc/kb": "EWHC (KB)",
    "ewhc/qb": "EWHC (QB)", "ewhc/admlty": "EWHC (Admlty)", "ewhc/admin": "EWHC (Admin)",
    "ewhc/fam": "EWHC (Fam)", "ewhc/pat": "EWHC (Pat)", "ewhc/ipec": "EWHC (IPEC)", "ewhc/scco": "EWHC (SCCO)",
}

# Letters of a State's form that stand for it in a case name, and words that show a sovereign party.
STATE_STEM = 5
SOVEREIGN = r"\b(republic|government|kingdom|state of|federation|ministry|emirate|sultanate|commonwealth|nation)\b"

# What a judgment is about, in order: pattern, event type, description.
COURT_KINDS = (
    (
        r"set(?:ting)? aside|vacat|annul|section 6[789]\b|s\.? ?6[789]\b|serious irregularity|recourse against|challenge to (?:the )?award|"
        r"appeal (?:on a point of law )?(?:from|against) (?:the |an )?award|vernietig|aufhebung|aufgehoben|aufhebungsantrag",
        "annulment_setaside", "challenge to an award",
    ),
    (
        r"enforc|recogni|exequatur|tenuitvoerlegging|erkenning|vollstreckbar|new york convention|section (?:66|101)\b|homologation|registration of (?:the |an )?award",
        "enforcement_action", "enforcement of an award",
    ),
    (
        r"removal of (?:an |the )?arbitrator|section 24\b|apparent bias|impartial|challenge to (?:an |the )?arbitrator|befangen|wraking",
        "tribunal_constituted", "challenge to an arbitrator",
    ),
    (
        r"anti-?suit|stay of (?:court )?proceedings|stay in favour|section 9\b|s\.? ?9\b|sursis|refer(?:ral)? to arbitration|arbitration (?:agreement|clause)|"
        r"kompetenz|jurisdiction of (?:the )?(?:arbitral )?tribunal|schiedsvereinbarung|schiedsklausel|arbitrabil",
        "commercial_dispute", "arbitration agreement, stay or anti-suit relief",
    ),
    (
        r"section 44\b|interim (?:relief|measure|injunction)|freezing|in (?:aid|support) of (?:an )?arbitration",
        "commercial_dispute", "interim relief in support of arbitration",
    ),
)
# Courts by their part of an address, and by their letters.
COURT_CODES = {
    "uksc": "UKSC", "ukpc": "UKPC", "ewca/civ": "EWCA Civ", "ewca/crim": "EWCA Crim", "ewhc/comm": "EWHC (Comm)", "ewhc/tcc": "EWHC (TCC)", "ewhc/ch": "EWHC (Ch)",
    "ewhc/kb": "EWHC (KB)", "ewhc/qb": "EWHC (QB)", "ewhc/admlty": "EWHC (Admlty)", "ewhc/admin": "EWHC (Admin)", "ewhc/fam": "EWHC (Fam)", "ewhc/pat": "EWHC (Pat)",
    "ewhc/ipec": "EWHC (IPEC)", "ewhc/scco": "EWHC (SCCO)",
}
CATCHWORD_COURTS = {
    "SGHC": "High Court of Singapore", "SGHC(I)": "Singapore International Commercial Court", "SGCA": "Court of Appeal of Singapore",
    "SGCA(I)": "Court of Appeal of Singapore (SICC appeal)", "SGHCR": "High Court of Singapore (Registrar)", "SGHC(A)": "Appellate Division of the High Court",
}

# The fields of a record in a day's file.
DAY_FIELDS = (
    "record", "id", "title", "title_en", "summary", "summary_en", "url", "source", "source_tier", "event_type", "published_at", "institution", "treaty", "case_ref",
    "claimants", "respondents", "states", "sectors", "counsel", "arbitrators", "amount_usd", "flag_reason", "why_it_matters", "also", "lang", "country", "corroboration", "story",
)

# Event types of a story that starts a dispute, which leads before others.
STARTERS = ("notice_of_intent", "new_case_filed", "counsel_tender", "s1782_application", "state_measure")

# Acts that a headline names, their order in a query, and States under short names.
ACTS = (
    r"\b(award|arbitration|arbitral|annul\w*|set aside|enforce\w*|confirm\w*|vacat\w*|tribunal|ICSID|claim|dispute|treaty|expropriat\w*|licen[cs]e|concession|notice|"
    r"settle\w*|damages|immunity|attach\w*|seiz\w*)\b"
)
ACT_ORDER = ("award", "arbitration", "arbitral", "tribunal", "icsid", "treaty", "expropriation", "enforcement", "annulment")
SHORT_STATES = {"United States": "US", "United Kingdom": "UK", "United Arab Emirates": "UAE", "Congo (DRC)": "Congo", "Congo (Brazzaville)": "Congo", "Korea": "Korea"}
# Nouns after which an opening counts as that of a described party.
DESCRIBED = (
    "company", "investor", "contractor", "group", "court", "tribunal", "judge", "businessman", "developer", "producer", "miner", "bank", "insurer", "consortium", "arbitrator", "panel",
)
# Where sites keep their feeds.
FEED_PATHS = (
    "/feed/", "/feed", "/rss", "/rss.xml", "/feed.xml", "/rss/", "/index.xml", "/atom.xml", "/?feed=rss2", "/en/feed/", "/en/rss", "/en/rss.xml", "/arc/outboundfeeds/rss/",
    "/rss/news", "/feeds/posts/default",
)
# Capitalised words that are part of a court's or an office's name, not a party's.
NAME_NOISE = ("us", "uk", "new", "high", "supreme", "state", "federal", "district", "national")
# An entry of a letter, and the label at its head.
LETTER_ITEM = r"^(.*?)\s+\((https?://[^\s)]+)\)\s*$"
LETTER_LABEL = r"^(\[[^\]]+\]|[A-Z][A-Za-z\- ]{2,24}:)\s*"
# The rule between a letter's stories, and how its footers begin.
LETTER_RULE = "------------------------------"
LETTER_FOOTER = (
    "Subscribe", "Follow on LinkedIn", "Law Business Research", "Manage your email", "To receive our emails", "Registered in England", "View in browser", "GAR logo",
)
