"""Word lists, tables, patterns and thresholds. Order matters where a rule takes the first match."""

# ---- fixed values: results depend on these exact entries and their order ----

CSE_KEYWORDS = ("nic", "crsorgi", "irctc", "sbi", "icici", "hdfc", "pnb", "bob", "airtel", "iocl", "onlinesbi", "sbicard", "icicibank", "hdfcbank", "pnbindia", "bankofbaroda", "airtel", "irctc", "rail", "railway", "gov.in", "crsorgi", "census", "uidai")
RISKY_TLDS = ("xyz", "top", "buzz", "info", "click", "tk", "cn", "cf", "ga", "gq", "ml", "bet", "red", "sbs", "fun", "icu", "cyou", "shop", "live", "online", "site")
SUSPICIOUS_TRIGRAMS = ("sec", "log", "ver", "upd", "kyo", "pay", "net", "ban", "inf", "ref", "acc", "act", "onl", "mob", "app", "srv", "usr", "sup", "hel", "cus", "ser", "por", "tal", "aut")
LEGITIMATE_TRIGRAMS = ("com", "gov", "org", "edu", "the", "and", "ing", "ion", "ent", "ati", "tio", "ers")
LURE_WORDS = ("login", "signin", "secure", "account", "verify", "update", "support", "banking", "paypal", "auth", "security", "confirm")
WATCHLIST = ("irctc", "sbi", "statebank", "icici", "hdfc", "pnb", "bankofbaroda", "bob", "airtel", "iocl", "indianoil", "nic", "gov", "crsorgi", "censusindia")
SERVICE_WORDS = ("ifsc", "code", "find", "search", "locate", "directory", "calculator", "emi", "rate", "info", "portal")
GENERIC_TARGETS = ("Financial Institution (Generic)", "Government Service (Generic)")
BRAND_ORDER = (
    ("crsorgi", "Registrar General and Census Commissioner of India (RGCCI)", "dc.crsorgi.gov.in"),
    ("irctc", "Indian Railway Catering and Tourism Corporation (IRCTC)", "irctc.co.in"),
    ("nic", "National Informatics Centre (NIC)", "nic.gov.in"),
    ("sbi", "State Bank of India (SBI)", "onlinesbi.sbi"),
    ("icici", "ICICI Bank", "icicibank.com"),
    ("hdfc", "HDFC Bank", "hdfcbank.com"),
    ("pnb", "Punjab National Bank (PNB)", "pnbindia.in"),
    ("bob", "Bank of Baroda (BoB)", "bankofbaroda.in"),
    ("airtel", "Airtel", "airtel.in"),
    ("iocl", "Indian Oil Corporation Limited (IOCL)", "iocl.com"),
)
GUARDED_BRANDS = (
    ("Indian Railway Catering and Tourism Corporation (IRCTC)", ("irctc",)),
    ("State Bank of India (SBI)", ("sbi", "statebank", "sbicard")),
    ("ICICI Bank", ("icici",)),
    ("HDFC Bank", ("hdfc",)),
    ("Punjab National Bank (PNB)", ("pnb",)),
    ("Bank of Baroda (BOB)", ("bankofbaroda", "bob")),
    ("Airtel", ("airtel",)),
    ("Indian Oil Corporation Limited (IOCL)", ("iocl", "indianoil")),
    ("National Informatics Centre (NIC)", ("nic.", "gov.in", "india.gov")),
    ("Registrar General and Census Commissioner of India (RGCCI)", ("crsorgi", "censusindia")),
)
GENERIC_WORDS = (
    ("Financial Institution (Generic)", ("bank", "credit", "loan", "card")),
    ("Government Service (Generic)", ("gov", "government", "india")),
    ("Telecom Service (Generic)", ("airtel", "jio", "vi")),
)
EDIT_KEYWORDS = ("irctc", "sbi", "icici", "hdfc", "pnb", "bob", "airtel", "iocl", "nic", "crsorgi")
ANALYZER_BRANDS = (("NIC", ("nic", "national informatics", "gov.in", "digital india")), ("SBI", ("sbi", "state bank", "onlinesbi")), ("IRCTC", ("irctc", "indian railway")))
SUFFIX_RISKY = (".xyz", ".top", ".club", ".online", ".site", ".website")
SUFFIX_SAFE = (".gov.in", ".nic.in", ".co.in", ".ac.in", ".org", ".edu")
RULE_SUFFIXES = (".tk", ".ml", ".ga", ".cf", ".xyz", ".top", ".club")
THIRD_TLDS = ("xyz", "top", "cyou", "sbs", "buzz", "icu", "shop", "site", "live", "ltd")
COMMON_TLDS = ("com", "org", "net", "edu", "gov")
COMMON_SUFFIXES = ("com", "org", "net", "in", "gov", "edu")
TUNNEL_SUFFIXES = (".ngrok.io", ".ngrok-free.app", ".vercel.app", ".cloudflare.com", ".trycloudflare.com", ".loca.lt", ".serveo.net", ".onrender.com", ".workers.dev")
SOCIAL_WHITELIST = ("t.me", "telegram.org", "google.com", "youtu.be", "youtube.com", "twitter.com", "facebook.com", "instagram.com", "linkedin.com")
PHISHTANK_BRANDS = ("sbi", "hdfcbank", "icici", "pnb", "uidai", "irctc", "npci", "axisbank", "bankofbaroda", "indianbank", "canarabank", "incometax", "epfo", "nsdl", "sebi", "nic", "gov.in", "india")
SECTOR_PATTERNS = (".gov.in", ".nic.in", ".ac.in", ".res.in", "banking", "payment", "kyc", "aadhar", "pan-card", "voterid")
PRIVACY_TERMS = ("redacted", "privacy", "protected", "whoisguard", "domain privacy")
RISKY_REGISTRARS = ("namecheap", "public domain registry", "pdr ltd", "tucows")
REGISTRAR_RISK = {
    "NAMECHEAP": 0.9,
    "NAMECHEAP INC": 0.9,
    "GO DADDY, LLC": 0.7,
    "GODADDY.COM, LLC": 0.7,
    "TUCOWS DOMAINS, INC.": 0.6,
    "PORKBUN LLC": 0.8,
    "DYNADOT LLC": 0.75,
    "GMO INTERNET, INC.": 0.85,
    "HOSTINGER OPERATIONS, UAB": 0.9,
    "NAMESILO, LLC": 0.7,
    "SPACESHIP, INC.": 0.65,
    "IONOS SE": 0.3,
    "WIX.COM LTD.": 0.4,
    "SQUARESPACE DOMAINS LLC": 0.35,
    "NETWORK SOLUTIONS, LLC": 0.4,
    "AMAZON REGISTRAR, INC.": 0.2,
    "GOOGLE DOMAINS": 0.1,
}
REGISTRAR_DEFAULT = 0.5
COUNTRY_COORDS = {
    "IN": (20.5937, 78.9629),
    "US": (37.0902, -95.7129),
    "GB": (55.3781, -3.4360),
    "DE": (51.1657, 10.4515),
    "JP": (36.2048, 138.2529),
    "CA": (56.1304, -106.3468),
    "AU": (-25.2744, 133.7751),
    "BR": (-14.2350, -51.9253),
    "FR": (46.2276, 2.2137),
    "RU": (61.5240, 105.3188),
}
HOME = (20.5937, 78.9629)
EARTH_KM = 6371.0
WHOIS_DATE_PATTERNS = (
    r"Creation Date:\s*([0-9-]{10}T[0-9:]{8}Z)",
    r"Creation Date:\s*([0-9-]{10})",
    r"created:\s*([0-9-]{10})",
    r"Registered on:\s*([0-9-]{10})",
    r"\[Created on\]\s*([0-9]{4}/[0-9]{2}/[0-9]{2})",
    r"Creation Date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
    r"Registration Time:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})",
)
UTILITY_PATTERNS = (
    r"ifsc\.bankifsccode\.com",
    r"bankifsccode\.com",
    r"rbi\.org\.in",
    r"indianbank\.net\.in/ifsc",
    r"ifsccodebank\.in",
    r"allbankifsccode\.com",
    r"findifsc\.code\.in",
    r"india\.gov\.in",
    r"nic\.in",
    r"digitalindia\.gov\.in",
    r"mygov\.in",
    r"incometaxindia\.gov\.in",
    r"incometaxindiaefiling\.gov\.in",
    r"epfindia\.gov\.in",
    r"uidai\.gov\.in",
    r"pgportal\.gov\.in",
    r"iit.*\.ac\.in",
    r"nit.*\.ac\.in",
    r"iim.*\.ac\.in",
    r"ugc\.ac\.in",
    r"aicte\.ind\.in",
    r"moneycontrol\.com",
    r"economictimes\.indiatimes\.com",
    r"nseindia\.com",
    r"bseindia\.com",
    r"paytm\.com",
    r"phonepe\.com",
    r"googlepay\.com",
    r"amazonpay\.in",
    r"bankbazaar\.com",
    r"paisabazaar\.com",
    r"policybazaar\.com",
)
SOFT_PATTERNS = (r"login.*portal", r"secure.*bank", r"online.*payment", r"verify.*account")
UTILITY_CATEGORIES = (
    ("banking_utility", (r"ifsc\.", r"bankifsccode", r"ifsccode", r"bankifsc", r"rbi\.org\.in", r"indianbank\.net\.in/ifsc")),
    ("government", (r"\.gov\.in", r"india\.gov", r"nic\.in", r"digitalindia", r"mygov\.in", r"incometaxindia", r"epfindia", r"uidai")),
    ("educational", (r"\.ac\.in", r"ugc\.ac\.in", r"aicte\.ind\.in")),
    ("financial_portal", (r"moneycontrol", r"economictimes", r"nseindia", r"bseindia")),
    ("payment_gateway", (r"paytm", r"phonepe", r"googlepay", r"amazonpay")),
)
LABEL_VARIANTS = (
    ("Phishing", ("phishing", "phishing/suspected", "phishing/ suspected")),
    ("Suspected", ("suspected", "suspect", "suspicious")),
    ("Legitimate", ("legitimate", "legit", "benign", "safe")),
)
TEMPLATE_WORDS = ("irctc", "sbi", "state_bank", "icici", "hdfc", "pnb", "bob", "bank_of_baroda", "airtel", "iocl", "nic", "rgcci")
HIDDEN_STYLES = ("display:none", "display: none", "visibility:hidden", "visibility: hidden")
CONFUSABLES = {
    "a": "аɑӓα",
    "b": "Ьβв",
    "c": "сϲƈ",
    "d": "ԁժɗ",
    "e": "еëéêε",
    "g": "ɡġğ",
    "h": "һհ",
    "i": "і1líïι",
    "j": "ϳј",
    "k": "кκ",
    "l": "ӏ1iι",
    "m": "мɱ",
    "n": "пηñ",
    "o": "о0οö",
    "p": "рρ",
    "q": "ԛգ",
    "r": "гŕ",
    "s": "ѕ5ş",
    "t": "тτ",
    "u": "иυü",
    "v": "ѵν",
    "w": "ѡω",
    "x": "хχ",
    "y": "уγý",
    "z": "zž",
}
THRESHOLD, BAND, TRIGGER, BATCH_THRESHOLD = 0.65, (0.35, 0.65), 0.35, 0.5
SWEEP = (0.35, 0.45, 0.55, 0.65)

FILE_BRANDS = (
    ("sbi", "State Bank of India (SBI)"),
    ("irctc", "Indian Railway Catering and Tourism Corporation (IRCTC)"),
    ("icici", "ICICI Bank"),
    ("hdfc", "HDFC Bank"),
    ("pnb", "Punjab National Bank (PNB)"),
    ("bob", "Bank of Baroda (BOB)"),
    ("airtel", "Airtel"),
    ("iocl", "Indian Oil Corporation Limited (IOCL)"),
    ("nic", "National Informatics Centre (NIC)"),
)
CENSUS_TEMPLATE_WORDS = ("irctc", "sbi", "state_bank", "icici", "hdfc", "pnb", "bob", "airtel", "iocl", "nic", "rgcci", "census")
PICTURE_WORDS = ("sbi", "irctc", "icici", "hdfc", "pnb", "bob", "airtel", "iocl", "nic")
SECTOR_WORDS = ("sbi", "hdfc", "icici", "irctc", "airtel", "uidai", "paytm", "npci", "iocl", "pnb", "axis", "kotak", "jio", "bsnl", "phonepe")
UNUSUAL_TLDS = (".xyz", ".top", ".click", ".tk", ".cn", ".cf", ".ga", ".gq", ".ml", ".buzz", ".sbs", ".red", ".bet", ".fun", ".icu", ".cyou")
BRAND_AGE_DAYS = 3650
#: features that tell a name's rank and so its source; left out of training
RANK_FEATURES = ("tranco_rank", "is_in_tranco")
#: colours of a brand as hue (0 to 179), saturation and value (0 to 255), least and greatest
BRAND_COLOURS = {
    "State Bank of India (SBI)": {"blue": ((100, 150, 50), (140, 255, 255))},
    "ICICI Bank": {"blue": ((100, 150, 50), (140, 255, 255)), "orange": ((10, 150, 150), (25, 255, 255))},
    "HDFC Bank": {"blue": ((100, 150, 50), (140, 255, 255))},
}

# ---- own choices ----

#: phrases of a parked page
PARKED = ("domain is for sale", "buy this domain", "this domain is parked", "parked free", "domain parking")
