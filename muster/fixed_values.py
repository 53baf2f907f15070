"""Word lists, patterns, weights, labels, schemas and message
formats that results depend on.  They are data, not logic; every module that
needs one reads it from here, and callers can pass their own lists instead.
"""

# --------------------------------------------------------------- fixed values
# Column lists of the fixed target schemas.

SCRAPED_COLUMNS = [
    "profileUrl", "fullName", "firstName", "lastName", "companyName", "title", "companyId",
    "companyUrl", "regularCompanyUrl", "summary", "titleDescription", "industry", "companyLocation",
    "location", "durationInRole", "durationInCompany", "pastExperienceCompanyName",
    "pastExperienceCompanyUrl", "pastExperienceCompanyTitle", "pastExperienceDate",
    "pastExperienceDuration", "connectionDegree", "profileImageUrl", "sharedConnectionsCount",
    "name", "vmid", "linkedInProfileUrl", "isPremium", "isOpenLink", "query", "timestamp",
    "defaultProfileUrl", "searchAccountProfileId", "searchAccountProfileName",
]
SEGMENTED_COLUMNS = [
    "SalesNavUrl", "fullName", "firstName", "lastName", "companyName", "title", "companyId",
    "companyUrl", "regularCompanyUrl", "summary", "titleDescription", "industry",
    "companyLocation", "location", "durationInRole", "durationInCompany",
    "pastExperienceCompanyName", "pastExperienceCompanyUrl", "pastExperienceCompanyTitle",
    "pastExperienceDate", "pastExperienceDuration", "connectionDegree", "profileImageUrl",
    "sharedConnectionsCount", "name", "vmid", "linkedInProfileUrl", "isPremium", "isOpenLink",
    "query", "timestamp", "ProfileUrl", "searchAccountProfileId", "searchAccountProfileName",
    "Bank Size", "Seniority", "Focus Area", "Relevance",
]
SELECTION_COLUMNS = [
    "SalesNavUrl", "fullName", "firstName", "lastName", "companyName", "title",
    "companyId", "companyUrl", "regularCompanyUrl", "summary", "titleDescription",
    "industry", "companyLocation", "location", "durationInRole", "durationInCompany",
    "connectionDegree", "profileImageUrl", "sharedConnectionsCount", "name", "vmid",
    "linkedInProfileUrl", "isPremium", "isOpenLink", "query", "timestamp", "ProfileUrl",
    "searchAccountProfileId", "searchAccountProfileName", "Bank Size", "Seniority",
    "Focus Area", "Relevance",
]
CRM_COLUMNS = [
    "Record ID", "First Name", "Last Name", "Create Date", "Associated Company (Primary)",
    "Company Name", "Job Title", "Seniority", "Associated Email", "Email", "Phone Number",
    "Country Dropdown", "State Dropdown", "LinkedIn Url", "NA 25 Outreach Sequence",
    "Target Event Role", "BTS NA 25 Role", "Attendee_Cold_Status", "BTS NA 25 Attendance Status",
    "BTS NA 25 Date Registered", "Journey Stage", "Lifecycle Stage", "Expandi Team Member",
    "personalised registration link", "State/Region", "State/Region Code", "Country/Region",
    "Lifecycle Stage (EXPROM)", "Associated Company IDs (Primary)", "Associated Email IDs",
]
ALTERNATE_COLUMNS = [
    "_source_file", "_source_sheet", "profileUrl", "fullName", "firstName", "lastName",
    "companyName", "title", "companyId", "companyUrl", "regularCompanyUrl", "summary",
    "titleDescription", "industry", "companyLocation", "location", "durationInRole",
    "durationInCompany", "pastExperienceCompanyName", "pastExperienceCompanyUrl",
    "pastExperienceCompanyTitle", "pastExperienceDate", "pastExperienceDuration",
    "connectionDegree", "profileImageUrl", "sharedConnectionsCount", "name", "vmid",
    "linkedInProfileUrl", "isPremium", "isOpenLink", "query", "timestamp", "defaultProfileUrl",
    "searchAccountProfileId", "searchAccountProfileName", "Seniority", "Result", "First Name",
    "Last Name", "Title", "Person Linkedin Url", "City", "State", "Country", "Email", "Company",
    "Website", "Industry", "# Employees", "Annual Revenue", "Total Funding", "Company Phone",
    "Company Linkedin Url", "Company Street", "Company City", "Company Postal Code",
    "Company State", "Company Country", "Company Founded Year",
]
TARGET_COMPANY_COLUMNS = ["Company", "Sector", "Theme", "Notes", "Where From"]
OUTREACH_COLUMNS = [
    "Expandi Team Member", "firstName", "lastName", "companyName", "title", "location",
    "linkedInProfileUrl", "Seniority", "State", "City", "Country Dropdown", "Target Event Role",
]
EVENT_COLUMNS = [
    "email", "firstname", "lastname", "jobtitle", "Company Name", "country", "State", "Seniority",
]
EVENT_EXPORT_COLUMNS = [
    "email", "firstname", "lastname", "jobtitle", "Company Name", "country", "State",
    "Organisation Type", "Segment", "Seniority",
]
STATE_SPLIT_COLUMNS = EVENT_EXPORT_COLUMNS + ["Bucket"]
TOP_EXPORT_COLUMNS = [
    "_source_file", "_source_sheet_or_type", "firstName", "lastName", "companyName", "title",
    "location", "Email", "linkedInProfileUrl",
]

# Alternative header spellings per target column.
OUTREACH_ALIASES = {
    "expandi team member": ["expandi team member", "owner", "assignee", "agent", "team member", "expandi_owner"],
    "firstname": ["first name", "firstname", "given name", "first_name", "f_name"],
    "lastname": ["last name", "lastname", "surname", "last_name", "l_name"],
    "companyname": ["company", "company name", "organisation", "organization", "employer", "companyname"],
    "title": ["title", "job title", "role", "position"],
    "location": ["location", "city - state", "city, state", "geo", "region"],
    "linkedinprofileurl": [
        "linkedin", "linkedin url", "linkedin profile", "linkedinprofileurl", "li url", "profile url",
        "linkedin_profile", "linkedinprofile", "profileurl", "public profile url",
    ],
    "seniority": ["seniority", "level", "seniority level"],
    "state": ["state", "province", "state/region"],
    "city": ["city", "town"],
    "country dropdown": ["country", "country dropdown", "nation"],
    "target event role": ["target event role", "target role", "event role", "role target"],
}
SCRAPED_ALIASES = {
    "linkedInProfileUrl": ["linkedin", "linkedin_url", "linkedin profile", "profile url", "li_url", "profileUrl"],
    "profileUrl": ["profile url", "li_url", "linkedin_url"],
    "companyUrl": ["company url", "company_url", "employer_url"],
    "regularCompanyUrl": ["website", "company website", "domain", "root domain", "regular_url"],
    "companyName": ["employer", "organization", "org", "company"],
    "title": ["job title", "position", "role"],
    "fullName": ["name_full", "candidate", "contact", "fullname", "displayName"],
    "firstName": ["fname", "first name", "given_name"],
    "lastName": ["lname", "last name", "surname", "family_name"],
    "profileImageUrl": ["avatar", "photo", "image", "picture"],
    "connectionDegree": ["degree", "conn_degree", "relationship"],
    "isPremium": ["premium", "linkedin_premium"],
    "isOpenLink": ["open_link", "openlink"],
    "companyId": ["company_id", "employer_id"],
    "companyLocation": ["hq_location", "company_city", "employer_location"],
    "durationInRole": ["role_duration", "tenure_role"],
    "durationInCompany": ["company_tenure", "tenure_company"],
    "pastExperienceCompanyName": ["prev_company", "past_company", "experience_company"],
    "pastExperienceCompanyUrl": ["prev_company_url", "past_company_url"],
    "pastExperienceCompanyTitle": ["prev_title", "past_title", "experience_title"],
    "pastExperienceDate": ["prev_date", "experience_date", "dates_employed"],
    "pastExperienceDuration": ["prev_duration", "experience_duration"],
    "vmid": ["entity_urn", "vanity_id"],
    "query": ["search_query", "term", "keywords"],
    "timestamp": ["created_at", "exported_at", "scraped_at", "ts"],
    "defaultProfileUrl": ["fallback_profile_url", "profile_url_default"],
    "searchAccountProfileId": ["account_profile_id", "salesnav_account_id"],
    "searchAccountProfileName": ["account_profile_name", "salesnav_account_name"],
}
SEGMENTED_ALIASES = {
    "linkedInProfileUrl": ["linkedinprofileurl", "linkedin url", "profile url", "profileurl", "linkedin"],
    "ProfileUrl": ["profileurl", "profile url", "linkedin url", "linkedinprofileurl"],
    "companyName": ["company", "company_name", "employer"],
    "title": ["job title", "role", "position", "headline"],
    "fullName": ["fullname", "name", "display name"],
    "firstName": ["firstname", "first name", "given name"],
    "lastName": ["lastname", "last name", "surname", "family name"],
    "location": ["location", "city, state", "city", "state", "region"],
    "companyLocation": ["company location", "hq location", "company city", "company state"],
    "SalesNavUrl": ["salesnavurl", "sales navigator url", "sales navigator link"],
    "query": ["search query", "query string"],
    "timestamp": ["time", "created at", "added at", "timestamp"],
    "Relevance": ["relevance", "is relevant", "relevant"],
    "Focus Area": ["focus", "focus area", "focus_area"],
    "Seniority": ["seniority", "level", "seniority level"],
    "Bank Size": ["bank size", "size", "segment"],
}
SUBSTRING_HEADERS = {
    "title": ["title", "job title", "jobtitle", "position"],
    "location": ["location", "city", "state", "region", "province"],
}
COMPANY_LIST_HEADERS = ["company", "companyname", "name", "organisation", "organization"]
URL_HEADER_VARIANTS = ["linkedinprofileurl", "public profile url", "linkedin url", "linkedin_profile"]

# Company name cleaning.
MATCH_STOP_TOKENS = [
    "inc", "inc.", "ltd", "ltd.", "limited", "plc", "llc", "llp", "gmbh", "s.a.", "sa",
    "s.p.a", "spa", "bv", "b.v.", "ag", "corp", "corp.", "corporation", "company", "co",
    "co.", "group", "holdings", "holding", "technologies", "technology", "systems",
    "services", "solutions", "international", "int", "int.", "global", "the", "&", "bank",
]
BRAND_PUNCTUATION = r"[\.\,&\-/\(\)'\*]"
BRAND_SUFFIX_PATTERNS = [
    r",?\s+incorporated$", r",?\s+inc\.$", r",?\s+inc$", r",?\s+co\.$", r",?\s+company$",
    r",?\s+corp\.$", r",?\s+corporation$", r",?\s+llc$", r",?\s+l\.l\.c\.$",
    r",?\s+lp$", r",?\s+l\.p\.$", r",?\s+llp$", r",?\s+l\.l\.p\.$", r",?\s+plc$",
    r",?\s+limited$", r",?\s+ltd\.$", r",?\s+ltd$", r",?\s+sa$", r",?\s+ag$", r",?\s+spa$",
    r",?\s+gmbh$", r",?\s+pte\.?\s+ltd\.?$",
    r",?\s+n\.a\.$", r",?\s+na$", r",?\s+national\s+association$",
    r",?\s+credit\s+union$", r",?\s+financial\s+group$", r",?\s+financials?$",
    r",?\s+group$", r",?\s+holdings?$", r",?\s+bank$", r",?\s+bank\s+na$",
    r",?\s+securities$", r",?\s+markets?$", r",?\s+capital\s+markets?$",
]
BRAND_STOP_TOKENS = [
    "bank", "banks", "credit", "union", "financial", "finance", "group", "holding", "holdings",
    "corp", "corporation", "company", "limited", "ltd", "inc", "llc", "plc", "na", "n.a",
    "usa", "u.s.", "us", "uk", "canada", "texas", "ny", "nyc", "california", "america",
    "banamex", "cib", "securities", "markets", "capital", "national", "association",
    "nb", "n.a.", "nv", "ag", "sa", "spa", "gmbh",
]
CORE_SUFFIX_TOKENS = [
    "limited", "ltd", "plc", "llc", "inc", "inc.", "corp", "corporation",
    "gmbh", "ag", "sa", "s.a.", "bv", "b.v.", "oy", "ab", "nv", "srl", "s.r.l.",
    "pty", "pty ltd", "kk", "k.k.", "co", "co.", "company", "holdings", "group",
    "lp", "llp", "sasu", "sas", "spa", "s.p.a.", "ulc", "p.l.c.", "pte", "pte. ltd",
]
CORE_COUNTRY_TOKENS = [
    "uk", "usa", "us", "u.s.", "u.s.a.", "ireland", "ire", "gb", "uae", "eu",
    "europe", "singapore", "s’pore", "sng", "hk", "hong", "kong", "china",
    "japan", "india", "canada", "ca", "aus", "australia",
]
COMPANY_ACRONYMS = ["hsbc", "ubs", "bbva", "bny", "tsb", "abn", "cibc", "rbs", "bbt"]

# Two-list filter: titles and companies looked for.
WANTED_TITLES = [
    "Chief Information Security Officer",
    "CISO",
    "Head of IT Risk and Compliance",
    "Group CIO / CIO / Chief Information Officer",
    "Director, IT Strategy and Transformation",
    "IT Strategy Director",
    "Group CTO / CTO / Chief Technology Officer",
    "Global CTO",
    "Head of IT",
    "IT Director",
    "Director of Technology",
    "Technology and Operations Director",
    "Chief Operating Officer for IT / Information Technology",
    "Director of Operations and Transformation",
    "VP Infrastructure and Operations",
    "Head of Infrastructure",
    "VP Cloud Infrastructure",
    "Director of Cloud Infrastructure",
    "Head of Enterprise Architecture",
    "Chief Data Officer",
    "IT Transformation Director / Head of IT Transformation",
]
WANTED_COMPANIES = [
    "Aareal Bank AG", "ABANCA", "ABC International Bank Plc", "ABN AMRO Clearing Bank", "AIB Group (UK) Plc",
    "Allica Bank", "Alpha Bank London Ltd", "Arbuthnot Latham & Co Ltd", "Banca Monte dei Paschi di Siena (BMPS)",
    "BANCA SELLA SPA", "Bank Of England", "Bank of Ireland (UK) Plc", "Bank of London and the Middle East Plc",
    "Bper Banca", "British Arab Commercial Bank Plc", "C Hoare & Co", "Caceis", "CAF Bank Ltd", "CaixaBank",
    "Close Brothers Ltd", "Commerzbank AG", "Coutts & Co", "Danske Bank UK", "Deutsche Pfandbriefbank AG", "EBRD",
    "EFG International", "GB Bank Ltd", "Groupe Bpce", "GULF INTERNATIONAL BANK (UK) LIMITED", "Habib Bank AG Zurich",
    "Halifax", "Handlesbanken", "ICBC Standard Bank", "Intesa Sanpaolo", "Investec Bank PLC", "Kexim Bank (UK) Ltd",
    "Leeds Building Society", "Manchester Building Society", "MARSHALL WACE LLP", "Monzo Bank", "Nationwide Building Society",
    "Nordea Bank Abp", "Nottingham Building Society", "OneSavings Bank Plc", "Oxbury Bank Plc", "Paragon Bank Plc", "Pictet",
    "Rabobank", "Sainsbury's Bank Plc", "Secure Trust Bank Plc", "Shawbrook Bank Ltd", "Skipton Building Society",
    "SMBC Group EMEA", "Starling Bank", "Tandem Bank Ltd", "Tesco Bank", "Tescos Bank", "The Co-operative Bank plc",
    "Triodos Bank UK Ltd", "Ulster Bank", "Union Bank UK Plc", "Vanquis Bank Ltd", "Virgin Money UK PLC",
    "WEST BROMWICH BUILDING SOCIETY", "Yorkshire Bank", "Yorkshire Building Society", "Zopa Bank Ltd",
]

# Job title expansion: pattern -> appended phrase, applied in this order.
TITLE_EXPANSIONS = [
    (r"\bai\b", " artificial intelligence"),
    (r"\bml\b", " machine learning"),
    (r"\bnlp\b", " natural language processing"),
    (r"\brpa\b", " robotic process automation automation"),
    (r"\bbi\b", " business intelligence"),
    (r"\bcx\b", " customer experience"),
    (r"\bux\b", " user experience"),
    (r"\bui\b", " user interface"),
    (r"\bgrc\b", " governance risk compliance"),
    (r"\biam\b", " identity and access management identity access"),
    (r"\bkyc\b", " know your customer"),
    (r"\bkyb\b", " know your business"),
    (r"\bcdd\b", " customer due diligence"),
    (r"\bedd\b", " enhanced due diligence"),
    (r"\bofac\b", " sanctions ofac"),
    (r"\bpci\b", " pci dss"),
    (r"\bncino\b", " core banking ncino"),
    (r"\bfed\s?now\b|\bfednow\b", " instant payments fednow"),
    (r"\bertp\b", " real time payments"),
    (r"\bitgc\b", " it general controls"),
    (r"\bpsm\b", " payment systems management"),
]
TITLE_TYPO = (r"\bmachine learnin\b", " machine learning")

# Organisation type and company type.
CREDIT_UNION_ORG_PATTERNS = [
    r"\bfederal credit union\b", r"\bcredit union\b", r"\bteachers? cu\b", r"\bcu\b", r"\bfcu\b",
]
CREDIT_UNION_HINTS = [r"\bcredit union\b", r"\bfcu\b", r"\bfederal credit union\b", r"\bcu\b"]

# Segment rules: (segment, core phrases, general phrases) in priority order.
RISK_CORE = ["risk"]
RISK_GENERAL = [
    "credit risk", "liquidity risk", "model risk", "operational risk", "enterprise risk",
    "risk officer", "risk management", "portfolio risk", "erm",
]
COMPLIANCE_CORE = ["compliance", "audit", "assurance"]
COMPLIANCE_GENERAL = [
    "regulatory", "internal audit", "sox", "ofac", "bsa", "aml", "fraud", "sanctions",
    "financial crime", "grc", "controls", "controls testing", "quality control",
    "kyc", "kyb", "cdd", "edd", "pci dss", "transaction monitoring",
    "information security risk and governance",
]
DATA_CORE = ["data", "analytics", "analyst", "analysis", "business intelligence", "bi"]
DATA_GENERAL = [
    "data science", "data engineering", "data engineer", "data governance",
    "data platform", "data warehouse", "data operations", "data architecture",
    "advanced analytics", "pricing analytics", "strategic analytics", "finance analytics",
    "bi developer", "bi analyst", "enterprise analytics", "market intelligence", "member intelligence",
]
AI_CORE = ["ai", "artificial intelligence", "machine learning", "ml"]
AI_GENERAL = ["generative ai", "gen ai", "deep learning", "nlp", "llm"]
DIGITAL_BANKING_CORE = ["digital banking", "online banking", "mobile banking"]
DIGITAL_BANKING_GENERAL = [
    "digital channels", "digital onboarding", "client experience", "omnichannel",
    "digital operations", "contact center digital", "contact centre digital",
]
INNOVATION_CORE = ["innovation"]
INNOVATION_GENERAL = ["incubation", "r&d", "lab", "ventures", "innovation & integration"]
TECHNOLOGY_CORE = [
    "it", "infrastructure", "network", "systems", "platform",
    "engineer", "architect", "administrator", "support", "operations",
    "devops", "sre", "cloud", "service desk", "helpdesk",
    "application analyst", "software engineer",
]
TECHNOLOGY_GENERAL = [
    "cloud operations", "cloud administrator", "endpoint", "configuration",
    "system administrator", "systems engineer", "environment", "server", "hardware",
    "telecommunications", "communications engineer", "network operations", "iam",
    "enterprise architect", "solutions architect", "solution architect", "architecture",
    "it governance", "it operations", "it service delivery", "it manager", "it director",
    "workday application support", "eiam", "it administration", "it asset",
    "endpoint management engineer", "principal it engineer",
    "it operations and service management", "communications systems specialist",
    "it delivery manager", "service delivery manager", "it support specialist",
    "it support manager", "network and telecommunications",
    "technical facilitator", "it technician", "it hardware technician",
    "it support", "it business relationship manager",
    "enterprise cloud platform manager",
]
CREDIT_UNION_SEGMENTS = [
    ("Risk", RISK_CORE, RISK_GENERAL),
    ("Compliance", COMPLIANCE_CORE, COMPLIANCE_GENERAL),
    ("Data", DATA_CORE, DATA_GENERAL),
    ("AI", AI_CORE, AI_GENERAL),
    ("Digital Banking", DIGITAL_BANKING_CORE, DIGITAL_BANKING_GENERAL),
    ("Technology", TECHNOLOGY_CORE, TECHNOLOGY_GENERAL),
]
BANK_SEGMENTS = [
    ("Risk", RISK_CORE, RISK_GENERAL),
    ("Compliance", COMPLIANCE_CORE, COMPLIANCE_GENERAL),
    ("Data", DATA_CORE, DATA_GENERAL),
    ("AI", AI_CORE, AI_GENERAL),
    ("Innovation", INNOVATION_CORE, INNOVATION_GENERAL),
    ("Technology", TECHNOLOGY_CORE, TECHNOLOGY_GENERAL),
]
SENIOR_SEGMENT = "Others (most senior)"
UNASSIGNED_SEGMENT = "Unassigned"
TECHNOLOGY_ANCHORS = [
    r"\b(it|information technology)\b",
    r"\bsystem(s)?\b", r"\bsystems?\s+engineer(ing)?\b",
    r"\bapplication\s+analyst\b", r"\bapplication(s)?\s+support\b",
    r"\binfrastructure\b", r"\bnetwork(ing)?\b", r"\bnetwork\s+security\b",
    r"\b(devops|sre)\b", r"\bcloud\b", r"\bplatform\b", r"\bendpoint\b",
    r"\bservice\s+desk\b", r"\bhelp\s*desk\b", r"\bsupport(\s+technician|\s+specialist|\b)\b",
    r"\barchitect\b", r"\bsolutions?\s+architect\b", r"\benterprise\s+architect\b",
    r"\badministrator\b", r"\bit\s+operations\b", r"\bit\s+service\s+delivery\b",
    r"\bsoftware\s+engineer\b", r"\bprincipal\s+software\s+engineer\b",
    r"\bengineering\s+director\b", r"\btechnical\b", r"\btechnical\s+engineering\b",
    r"\bworkday\s+application\s+support\b", r"\btelecommunications?\b",
    r"\bcommunications\s+systems?\s+specialist\b",
]
DATA_GATE = r"\b(data|analytics?|analyst|analysis|business intelligence|bi)\b"
INNOVATION_GATE = r"\binnovation|incubation|r&d|lab|ventures\b"
RISK_WORD = r"\brisk\b"
ANALYTICS_WORD = r"\banalytics?\b"
IDENTITY_ACCESS = r"\b(identity\s*(and\s*)?access|iam|identity access management)\b"
DIGITAL_WORD = r"\bdigital\b"
PRODUCT_WORD = r"\bproduct\b"
CHANNEL_BANKING = r"\b(digital|online|mobile)\s+banking\b"
LEADING_IT = r"^(it|information technology)\b"
BUSINESS_ANALYST = r"\bbusiness analyst\b"
SENIOR_FOR_OTHERS = [
    "director", "c-suite", "vice president", "leadership", "head", "chair/board member",
]
SENIOR_TITLE_PATTERN = (
    r"\b(chief|c[-\s]?suite|cfo|cio|cto|cdo|ciso|cro|ceo|coo|chair|board\s+member|"
    r"executive\s+vice\s+president|evp|senior\s+vice\s+president|svp|vice\s+president|vp|"
    r"managing\s+director|md|director|head|senior\s+manager|manager|managing\b)\b"
)
CREDIT_UNION_SEGMENT_ORDER = [
    "Risk", "Compliance", "Data", "AI", "Digital Banking", "Technology",
    "Others (most senior)", "Unassigned",
]
BANK_SEGMENT_ORDER = [
    "Risk", "Compliance", "Data", "AI", "Innovation", "Technology",
    "Others (most senior)", "Unassigned",
]

# Focus buckets: substrings of the title.
FOCUS_DATA = [
    "data", "analytics", "machine learning", "ml", "ai", "artificial intelligence",
    "automation", "rpa", "robotic process", "data science", "scientist", "data engineer",
    "ml engineer", "mlops", "genai", "gen ai", "llm", "prompt", "knowledge graph",
    "nlp", "computer vision", "model risk",
]
FOCUS_TRANSFORMATION = [
    "transformation", "change", "digital", "innovation", "innovate",
    "enterprise architect", "architecture", "architect", "product", "design",
    "experience", "cx", "ux", "strategy", "pm", "programme", "program manager",
    "agile", "scrum", "delivery", "cto", "cdo", "cpo", "head of digital",
]
FOCUS_RISK = [
    "risk", "compliance", "fraud", "conduct", "audit", "aml", "sanctions",
    "financial crime", "kyc", "model validation", "governance",
    "regulatory", "prudential", "sox", "basel", "grc", "bsa",
]
FOCUS_LABELS = [
    "Data / AI / Automation", "Transformation, digital, innovation", "Risk and Compliance", "All Others",
]
COMPANY_TYPES = ["Bank", "Credit Union"]

# Geography.
GENERIC_US_PATTERN = r"^(us|usa|u\.s\.a\.|united states|u\.s\.)$"
CHARLOTTE_TOKENS = ["charlotte", "charlotte metro", "charlotte-concord-gastonia"]
NC_TOKEN_PATTERN = r"(^|[ ,;/\(\)\-])nc($|[ ,;/\(\)\-])"
CHARLOTTE_BUCKET = "Charlotte"
NC_BUCKET = "North Carolina (not inc Charlotte)"
DEFAULT_BUCKET = "US"
STATE_NEEDLES = {
    "Georgia": ["georgia", " ga ", ", ga", "(ga)"],
    "Virginia": ["virginia", " va ", ", va", "(va)"],
    "Tennessee": ["tennessee", " tn ", ", tn", "(tn)"],
    "South Carolina": ["south carolina", " sc ", ", sc", "(sc)"],
    "New York": ["new york", " ny ", ", ny", "(ny)", "nyc"],
    "Texas": ["texas", " tx ", ", tx", "(tx)"],
    "Arizona": ["arizona", " az ", ", az", "(az)"],
    "Illinois": ["illinois", " il ", ", il", "(il)"],
    "California": ["california", " ca ", ", ca", "(ca)"],
    "Ohio": ["ohio", " oh ", ", oh", "(oh)"],
    "Washington": ["washington", " wa ", ", wa", "(wa)"],
}
MAIN_BUCKETS = [
    "Charlotte", "North Carolina (not inc Charlotte)", "Georgia", "Virginia", "Tennessee",
    "South Carolina", "New York", "Texas", "Arizona", "Illinois", "California", "Ohio",
    "Washington", "US",
]
FUZZY_STATES = {
    "North Carolina": ["North Carolina", "N Carolina", "NC"],
    "Virginia": ["Virginia", "VA"],
    "South Carolina": ["South Carolina", "S Carolina", "SC"],
    "Tennessee": ["Tennessee", "TN"],
    "Georgia": ["Georgia", "GA"],
}
OTHER_STATES = "Other States"
STATE_FUZZ_THRESHOLD = 85
SPLIT_STATES = {
    "Virginia": ["va"],
    "Tennessee": ["tn"],
    "Georgia": ["ga"],
    "South Carolina": ["sc"],
}
NC_CITIES = [
    "charlotte", "raleigh", "durham", "greensboro", "winston-salem", "fayetteville",
    "cary", "wilmington", "asheville", "high point", "concord", "greenville",
    "gastonia", "chapel hill", "jacksonville", "huntersville", "rocky mount",
    "apex", "holly springs", "wake forest", "hickory", "kannapolis", "kernersville",
    "matthews", "monroe", "mooresville", "mint hill", "salisbury", "wilson",
    "thomasville", "shelby", "garner", "goldsboro", "boone", "burlington",
    "morrisville", "new bern",
]

# Titles.
VIP_TITLE_PATTERNS = [
    r"\bsvp\b", r"\bsenior vice president\b",
    r"\bevp\b", r"\bexecutive vice president\b",
    r"\bchief\b", r"\bchief [a-z ]+ officer\b",
    r"\bcfo\b", r"\bcio\b", r"\bcto\b", r"\bcoo\b", r"\bciso\b", r"\bcmo\b",
    r"\bceo\b", r"\bcdo\b", r"\bcro\b", r"\bcco\b",
]
INFLUENCER_TITLE_PATTERN = (
    r"\b(ceo|chief|cso|cto|cdo|cio|coo|cfo|president|founder|cofounder|co-founder|chair|head|vp|"
    r"vice president|svp|evp|director|partner|principal)\b"
)
TITLE_SENIORITY_RULES = [
    (r"\b(chief|c[\.\s]*o\b|cdo\b|cfo\b|cio\b|cto\b|cso\b|ciso\b)\b", 100, "C-Suite"),
    (r"\b(managing director|md)(?![a-z])", 96, "Managing Director"),
    (r"\b(president|co-?founder|founder|owner|partner)\b", 94, "Founder or President"),
    (r"\b(executive vice president|evp)\b", 92, "EVP"),
    (r"\b(senior vice president|svp)\b", 90, "SVP"),
    (r"\b(vice president|vp)\b", 80, "Vice President"),
    (r"\b(global head|head of|head)\b", 72, "Head"),
    (r"\b(director|principal)\b", 70, "Director"),
    (r"\b(associate director|ad)\b", 66, "Associate Director"),
    (r"\b(manager|mgr)\b", 60, "Manager"),
    (r"\b(lead)\b", 55, "Lead"),
    (r"\b(senior|sr\.)\b", 50, "Senior"),
    (r"\b(consultant|specialist|architect)\b", 46, "Consultant"),
    (r"\b(associate)\b", 40, "Associate"),
    (r"\b(analyst|researcher)\b", 35, "Analyst"),
    (r"\b(coordinator|administrator)\b", 30, "Coordinator"),
    (r"\b(intern|trainee|apprentice)\b", 15, "Entry-Level"),
]
GLOBAL_LEAD_RULE = (r"\bglobal lead\b", 68, "Global Lead")
SENIORITY_SCORES = {
    "Chair/Board Member": 102,
    "C-Suite": 100,
    "Vice President": 90,
    "Head": 85,
    "Director": 80,
    "Leadership": 72,
    "Manager": 65,
    "Senior": 55,
    "Consultant": 50,
    "Non-Senior Banker": 40,
    "Entry-Level": 10,
}
SENIORITY_SYNONYMS = {
    "Chair/Board Member": ["board", "board member", "chair", "chairman", "chairwoman", "chair person", "chairperson"],
    "C-Suite": ["c suite", "csuite"],
    "Vice President": ["vp", "v p"],
}
SENIORITY_LATE_SYNONYMS = {
    "Entry-Level": ["entry level"],
    "Non-Senior Banker": ["non senior banker"],
}
PREFERRED_SPREAD = ["C-Suite", "Chair/Board Member", "Vice President", "Director", "Head"]
SENIORITY_TITLE_HINTS = [
    ("C-Suite", [" chief ", " cto", " cio", " cdo", " ciso", " cfo", "ceo", "coo"]),
    ("Chair/Board Member", [" chair", " board"]),
    ("Vice President", [" vp", "vice president"]),
    ("Leadership", ["executive", "leadership"]),
    ("Director", [" director "]),
    ("Head", [" head "]),
    ("Senior", [" senior ", " sr ", "principal"]),
    ("Manager", [" manager "]),
    ("Consultant", [" consultant ", " advisory ", " advisor "]),
    ("Non-Senior Banker", [" associate ", " analyst ", "officer"]),
    ("Entry-Level", [" intern ", "graduate", "trainee"]),
]
SENIORITY_WEIGHTS = {
    "C-Suite": 10,
    "Chair/Board Member": 10,
    "Vice President": 8,
    "Leadership": 8,
    "Director": 7,
    "Head": 7,
    "Senior": 5,
    "Manager": 5,
    "Consultant": 3,
    "Non-Senior Banker": 3,
    "Entry-Level": 1,
}
TITLE_KEYWORDS = {
    "ai": 6, "artificial intelligence": 6, "genai": 6, "machine learning": 5, "ml": 4, "data": 4,
    "chief": 6, "cdo": 6, "cio": 6, "cto": 6, "ciso": 6, "coo": 5, "cfo": 5,
    "vp": 5, "vice president": 5, "director": 4, "head": 4, "lead": 3, "manager": 2,
    "transformation": 6, "digital": 4, "innovation": 5, "strategy": 4, "architecture": 5,
    "architect": 5, "platform": 3, "engineering": 3, "engineer": 3, "cloud": 4,
    "security": 4, "cyber": 4, "payments": 3, "core banking": 5, "modernisation": 4,
    "modernization": 4, "automation": 4, "risk": 3, "compliance": 3, "fraud": 3,
    "analytics": 4, "business intelligence": 4, "devops": 3, "product": 3,
}
TITLE_PENALTIES = {
    "recruiter": -4, "talent": -3, "hr": -2, "student": -5, "intern": -6,
    "retired": -10, "consultant at": -2,
}
FOCUS_KEYWORDS = [
    "ai", "genai", "machine learning", "ml", "data", "digital", "transformation", "innovation",
    "architecture", "platform", "cloud", "security", "cyber", "payments", "automation",
    "core banking", "modernisation", "modernization", "bi", "analytics", "devops", "product",
]
LEADERSHIP_LABELS = ["C-Suite", "Chair/Board Member", "Vice President", "Leadership", "Director", "Head"]
MANAGER_LABELS = ["Senior", "Manager"]
BALANCE_SHARES = {"leadership": 0.35, "manager": 0.40, "specialist": 0.25}
SCORE_WEIGHTS = {"seniority": 0.5, "title": 0.35, "focus": 0.12, "connection": 0.03}
CLOSE_DEGREES = ["1", "1st", "First", "first"]

# Outreach message wording; the {FirstName} placeholder stays in the text.
MESSAGE_CONNECTION = (
    "Hi {FirstName},\n\n"
    "I’m connecting with %s leaders across %s who are driving projects in AI, data and automation. "
    "It would be great to connect and share insights ahead of a summit in Charlotte this November.\n\n"
    "Best regards, Mark"
)
MESSAGE_FOLLOW_UP_1 = (
    "Hi {FirstName},\n\n"
    "I’m reaching out to senior %s leaders in %s as we prepare for the Banking Transformation Summit in Charlotte this Nov "
    "- focused on data, AI and digital change. Thought this could be relevant for you.\n\n"
    "Best regards, Mark"
)
MESSAGE_FOLLOW_UP_2 = (
    "Hi {FirstName},\n\n"
    "We organise Banking Transformation Summit – the leading AI and transformation event for %s. "
    "Given your role with %s, I thought this would be highly relevant and wanted to share a VIP guest pass to attend.\n\n"
    "Best regards, Mark"
)
MESSAGE_INDUSTRY = {"Credit Union": ("credit union", "credit unions"), "Bank": ("banking", "banks")}
MESSAGE_FOCUS = {
    "Data / AI / Automation": "data and AI",
    "Transformation, digital, innovation": "digital transformation and innovation",
    "Risk and Compliance": "risk and compliance",
    "All Others": "your work",
}
MESSAGE_ANYWHERE = "the US"

# Values that count as missing when a text export is read with type inference.
NA_TEXT = ["", "NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A"]
# ----------------------------------------------------------- end fixed values
