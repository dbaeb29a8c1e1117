"""Value domains of the opportunity model.

Fixed values: every name, label, number and pattern in this module is part of
the data model and must stay as it is for results to agree.
"""

from __future__ import annotations

EDUCATION_LEVELS = ["MIDDLE", "SECONDARY", "SENIOR_SECONDARY", "UNDERGRAD", "GAP_YEAR"]
VISIBLE_STATES = ["VERIFIED", "RECENTLY_VERIFIED", "NEEDS_REVIEW", "UNVERIFIED"]
VERIFICATION_STATES = [*VISIBLE_STATES, "EXPIRED", "ARCHIVED"]
HARD_DIMENSIONS = ["AGE", "GRADE", "EDUCATION_LEVEL", "COUNTRY", "RESIDENCY", "CITIZENSHIP", "SCHOOL_ENROLMENT"]

DEADLINE_LABELS = {
    "APPLICATION_DEADLINE": "Application deadline",
    "EARLY_DEADLINE": "Early application deadline",
    "REGISTRATION_DEADLINE": "Registration deadline",
    "DOCUMENT_DEADLINE": "Documents due",
    "INTERVIEW_WINDOW": "Interview window",
    "APPLICATION_OPENS": "Applications open",
    "PROGRAM_START": "Programme starts",
    "PROGRAM_END": "Programme ends",
    "RESULT_DATE": "Results announced",
    "NOTIFICATION_DATE": "Decisions notified",
}
DEADLINE_KINDS = list(DEADLINE_LABELS)
ACTIONABLE_KINDS = ["APPLICATION_DEADLINE", "EARLY_DEADLINE", "REGISTRATION_DEADLINE", "DOCUMENT_DEADLINE"]
APPLICATION_STATUS_LABELS = {
    "CONSIDERING": "Considering",
    "PREPARING": "Preparing",
    "STARTED": "Application started",
    "SUBMITTED": "Submitted",
    "INTERVIEW": "Interview",
    "ACCEPTED": "Accepted",
    "WAITLISTED": "Waitlisted",
    "REJECTED": "Not selected",
    "WITHDRAWN": "Withdrawn",
    "COMPLETED": "Completed",
}
CLOSED_STATUSES = ["ACCEPTED", "REJECTED", "WITHDRAWN", "COMPLETED"]
TASK_LEAD_DAYS = {"RECOMMENDATION": 21, "TRANSCRIPT": 10, "PORTFOLIO": 14, "ESSAY": 10, "IDENTITY": 7, "INTERVIEW_PREP": 5, "FEE": 3, "FORM": 3, "ACCOUNT": 2, "SUBMIT": 1, "CUSTOM": 3}

METHOD_CONFIDENCE = {"STRUCTURED_MARKUP": "HIGH", "LABELLED_PAGE_TEXT": "MEDIUM", "AI_EXTRACTED": "MEDIUM", "ADMIN_ENTERED": "HIGH", "ADMIN_CORRECTED": "HIGH", "USER_REPORTED": "LOW", "SEARCH_RESULT": "LOW"}
METHOD_RANK = {"ADMIN_CORRECTED": 6, "ADMIN_ENTERED": 5, "STRUCTURED_MARKUP": 4, "LABELLED_PAGE_TEXT": 3, "AI_EXTRACTED": 2, "USER_REPORTED": 1, "SEARCH_RESULT": 0}
NEVER_GENERATED_FIELDS = ["applicationDeadline", "deadlines", "eligibility", "costAmount", "costType", "organizationId", "organizerName"]

DIMENSION_WEIGHTS = {"SUBJECT": 30, "CAREER": 15, "FORMAT_LOCATION": 12, "COST": 12, "TIMING": 12, "EXPERIENCE": 10, "PROFILE_GAP": 9}
ENGINE_VERSION = "match@1.0.0"

STRENGTH_AREAS = {
    "academics": ["PUBLICATION", "CERTIFICATION"],
    "competitions": ["COMPETITION"],
    "research": ["PROJECT", "PUBLICATION"],
    "leadership": ["LEADERSHIP"],
    "community": ["SERVICE"],
    "creative": ["ARTS"],
    "sport": ["SPORT"],
}
AREA_FROM_KIND = {"COMPETITION": "competition", "PUBLICATION": "research", "PROJECT": "research", "LEADERSHIP": "leadership", "SERVICE": "volunteering", "CERTIFICATION": "course", "SPORT": "sports", "ARTS": "arts"}
COMPLETENESS_WEIGHTS = {"dateOfBirth": 22, "countryCode": 18, "interests": 22, "educationLevel": 14, "budget": 10, "availability": 8, "careerDirections": 6}

TITLE_STOPWORDS = "the a an of for and in on at to with programme program opportunity application applications apply online international national official website".split()
OFFICIAL_SUFFIXES = [r"\.edu$", r"\.ac\.[a-z]{2}$", r"\.edu\.[a-z]{2}$", r"\.gov$", r"\.gov\.[a-z]{2}$", r"\.gob\.[a-z]{2}$", r"\.int$"]
AGGREGATORS = ["scholarshipscorner.website", "opportunitydesk.org", "youthop.com", "opportunitiesforyouth.org", "scholarship-positions.com", "afterschoolafrica.com"]
TRACKING_PARAMETERS = r"^(?i:utm_.*|fbclid|gclid|mc_[ce]id|ref|source)$"

EU_COUNTRIES = "AT BE BG HR CY CZ DK EE FI FR DE GR HU IE IT LV LT LU MT NL PL PT RO SK SI ES SE IS LI NO".split()
MINIMUM_AGE, EU_CONSENT_AGE, CONSENT_TTL_DAYS = 13, 16, 14

#: Ordered: the first pattern that a requirement matches names its task kind.
REQUIREMENT_KINDS = [
    ("RECOMMENDATION", r"\b(recommendation|reference|referee|letter of support|nomination)\b"),
    ("TRANSCRIPT", r"\b(transcript|report card|academic record|mark ?sheet|grades?)\b"),
    ("ESSAY", r"\b(essay|personal statement|statement of purpose|motivation letter|cover letter|written response)\b"),
    ("PORTFOLIO", r"\b(portfolio|showreel|sample work|writing sample|audition|demo)\b"),
    ("IDENTITY", r"\b(passport|identity|id proof|birth certificate|photo id)\b"),
    ("FEE", r"\b(fee|payment|pay |registration cost|application charge)\b"),
    ("INTERVIEW_PREP", r"\b(interview|viva|selection round)\b"),
    ("ACCOUNT", r"\b(account|register|sign ?up|create a profile)\b"),
    ("FORM", r"\b(form|application form|questionnaire|details)\b"),
]

MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}

#: Ordered: the first pattern that a sentence matches says what its date is for.
DATE_KINDS = [
    ("EARLY_DEADLINE", r"\b(early(?:\s+bird)?\s+(?:deadline|application|registration)|early\s+decision)\b"),
    ("REGISTRATION_DEADLINE", r"\b(registration\s+(?:deadline|closes?|ends?)|register\s+by|last\s+date\s+to\s+register)\b"),
    ("DOCUMENT_DEADLINE", r"\b(document(?:s|ation)?\s+(?:deadline|due)|supporting\s+materials?\s+due)\b"),
    ("APPLICATION_DEADLINE", r"\b(application\s+deadline|deadline\s+(?:for|to)\s+apply|applications?\s+(?:close|due|must be (?:received|submitted))|apply\s+by|last\s+date\s+to\s+apply|closing\s+date|submission\s+deadline)\b"),
    ("INTERVIEW_WINDOW", r"\b(interviews?\s+(?:will be held|take place|scheduled)|interview\s+(?:date|window|round))\b"),
    ("PROGRAM_START", r"\b(programme?\s+(?:begins?|starts?)|course\s+(?:begins?|starts?)|commences?\s+on|start\s+date)\b"),
    ("PROGRAM_END", r"\b(programme?\s+ends?|course\s+ends?|end\s+date|concludes?\s+on)\b"),
    ("RESULT_DATE", r"\b(results?\s+(?:announced|declared|published)|winners?\s+announced)\b"),
    ("NOTIFICATION_DATE", r"\b(decisions?\s+(?:notified|announced)|applicants?\s+(?:will be )?notified|notification\s+date)\b"),
]
ROLLING = r"\b(rolling\s+(?:admission|basis|deadline)|applications?\s+(?:are\s+)?accepted\s+(?:on\s+a\s+rolling|year[-\s]?round)|no\s+fixed\s+deadline|open\s+until\s+filled)\b"

AGE_RANGES = [
    r"\b(?:ages?|aged)\s*(?:between\s*)?(\d{1,2})\s*(?:-|–|—|to|and)\s*(\d{1,2})\b",
    r"\b(\d{1,2})\s*(?:-|–|—|to)\s*(\d{1,2})[\s-]*year[\s-]*olds?\b",
]
AGE_UNDER = r"\b(?:under|below|younger than)\s*(?:the age of\s*)?(\d{1,2})\b"
AGE_OVER = r"\b(?:at least|minimum(?: age)? of|aged?|over|above)\s*(\d{1,2})\s*(?:years?(?:\s+old)?|or (?:older|above|over)|\+)\b"

#: What a student's own sentence may say of filters.
QUERY_AGES = [r"\bfor\s+(\d{1,2})[-\s]?year[-\s]?olds?\b", r"\b(?:aged?|age)\s+(\d{1,2})\b", r"\b(\d{1,2})[-\s]?year[-\s]?olds?\b"]
QUERY_FREE = r"\bfree\b|\bno (?:entry |application )?fee\b|\bfully funded\b|\bno cost\b"
QUERY_FORMATS = [("ONLINE", r"\bonline\b|\bvirtual\b|\bremote\b"), ("IN_PERSON", r"\bin[-\s]person\b|\bon[-\s]?campus\b|\bresidential\b")]
QUERY_LEVELS = [
    ("SENIOR_SECONDARY", r"\bhigh[-\s]?school\b|\bsecondary\b|\bsixth form\b|\bgrade (?:9|10|11|12)\b"),
    ("UNDERGRAD", r"\bundergraduate?\b|\buniversity students?\b|\bcollege students?\b"),
    ("MIDDLE", r"\bmiddle school\b"),
]
QUERY_SOON, QUERY_MONTH = r"\bthis (?:week)\b|\bclosing soon\b|\burgent\b", r"\bthis month\b"

CURRENCY_SYMBOLS = {"£": "GBP", "$": "USD", "€": "EUR", "₹": "INR", "¥": "JPY", "₦": "NGN", "₱": "PHP", "R$": "BRL"}
CURRENCY_CODES = "USD EUR GBP INR AUD CAD SGD AED CHF JPY CNY NGN ZAR KES PKR BDT BRL MXN SEK NOK DKK PLN NZD".split()
FREE = r"\b(free\s+of\s+charge|no\s+(?:entry|application|registration|participation)\s+fee|free\s+to\s+(?:enter|apply|participate|attend)|there\s+is\s+no\s+fee|fully\s+funded|no\s+cost\s+to\s+(?:participants|students))\b"
AID = r"\b(financial\s+aid|need[-\s]based\s+(?:aid|scholarship|support)|fee\s+waiver|bursar(?:y|ies)|scholarships?\s+(?:are\s+)?available|partial\s+funding|need[-\s]blind)\b"
FEE_BEFORE = r"\b(?:fee|cost|price|charge|payment|contribution|tuition)\b[^.]{0,60}?([£$€₹¥₦₱]|R\$)\s?(\d[\d,]*(?:\.\d{1,2})?)"
FEE_AFTER = r"([£$€₹¥₦₱]|R\$)\s?(\d[\d,]*(?:\.\d{1,2})?)[^.]{0,40}?\b(?:fee|cost|price|charge|payment|tuition)\b"
FEE_CODE = r"\b(?:fee|cost|price|charge|tuition)\b[^.]{0,60}?\b([A-Z]{3})\s?(\d[\d,]*(?:\.\d{1,2})?)"

ONLINE = r"\b(online|virtual(?:ly)?|remote(?:ly)?|web[-\s]?based|from\s+anywhere\s+in\s+the\s+world)\b"
IN_PERSON = r"\b(in[-\s]person|on[-\s]?site|on[-\s]?campus|residential|face[-\s]to[-\s]face|attend\s+in\s+person)\b"
HYBRID = r"\b(hybrid|blended(?:\s+format)?|both\s+online\s+and\s+in[-\s]person)\b"

#: (pattern, ignore case) in the order in which a sentence is tried.
REQUIREMENTS = [
    (r"\b(letters?\s+of\s+recommendation|recommendation\s+letters?|references?\s+(?:required|from)|referee)\b", True),
    (r"\b(academic\s+transcripts?|transcripts?|report\s+cards?|mark\s?sheets?)\b", True),
    (r"\b(personal\s+statements?|statement\s+of\s+purpose|motivation\s+letters?|essays?|written\s+responses?)\b", True),
    (r"\b(portfolios?|writing\s+samples?|showreels?|auditions?)\b", True),
    (r"\b(curriculum\s+vitae|résumés?|resumes?|CVs?)\b", False),
    (r"\b(application\s+forms?|registration\s+forms?)\b", True),
    (r"\b(proof\s+of\s+(?:age|identity|enrolment|enrollment)|passports?|birth\s+certificates?)\b", True),
]
BANNED_CLAIMS = [r"\bwill get you into\b", r"\bguarantee[sd]?\b", r"\bensures? (?:admission|acceptance|a place)\b", r"\b(?:harvard|oxford|cambridge|mit|stanford|ivy league)\b", r"\btop students always\b", r"\bboosts? your chances of (?:admission|getting in)\b", r"\blooks great on your (?:college|university) application\b", r"\bimpress(?:es)? admissions\b", r"\bessential for\b", r"\bmust-have\b"]

CATEGORY_TERMS = [
    ("scholarship", r"\bscholarships?\b|\bbursar(?:y|ies)\b|\bfinancial aid\b"),
    ("competition", r"\bcompetitions?\b|\bcontests?\b|\bchallenges?\b"),
    ("olympiad", r"\bolympiads?\b"),
    ("mun", r"\bmuns?\b|\bmodel united nations\b"),
    ("debate", r"\bdebat(?:e|ing)\b"),
    ("hackathon", r"\bhackathons?\b"),
    ("research", r"\bresearch\b|\bresearch programmes?\b"),
    ("internship", r"\binternships?\b|\bwork experience\b|\bplacements?\b"),
    ("summer-program", r"\bsummer (?:program(?:me)?s?|schools?|camps?)\b|\bpre[-\s]?college\b"),
    ("fellowship", r"\bfellowships?\b"),
    ("volunteering", r"\bvolunteer(?:ing)?\b|\bcommunity service\b"),
    ("leadership", r"\bleadership\b"),
    ("course", r"\bcourses?\b|\bmoocs?\b|\bclasses\b"),
    ("certification", r"\bcertifications?\b|\bcertificates?\b"),
    ("workshop", r"\bworkshops?\b"),
    ("conference", r"\bconferences?\b|\bsummits?\b"),
    ("entrepreneurship", r"\bentrepreneurship\b|\bstartup\b|\bbusiness plan\b"),
    ("writing", r"\bwriting (?:competitions?|contests?)\b|\bessay (?:competitions?|contests?)\b"),
    ("stem", r"\bstem\b"),
    ("arts", r"\barts?\b|\bmusic\b|\bdrama\b|\btheatre\b|\bdesign\b"),
    ("sports", r"\bsports?\b|\bathletics?\b"),
]
SUBJECT_TERMS = [
    ("medicine", r"\bmedicine\b|\bmedical\b|\bpre[-\s]?med\b|\bhealthcare\b"),
    ("biology", r"\bbiology\b|\bbiological\b|\blife sciences?\b"),
    ("molecular-biology", r"\bmolecular biology\b|\bgenetics\b|\bbiotech(?:nology)?\b"),
    ("chemistry", r"\bchemistry\b"),
    ("physics", r"\bphysics\b|\bastronomy\b|\bastrophysics\b"),
    ("mathematics", r"\bmaths?\b|\bmathematics\b"),
    ("computer-science", r"\bcomputer science\b|\bcoding\b|\bprogramming\b|\bsoftware\b|\bcs\b"),
    ("artificial-intelligence", r"\bai\b|\bartificial intelligence\b|\bmachine learning\b"),
    ("engineering", r"\bengineering\b|\brobotics\b"),
    ("environment", r"\benvironment(?:al)?\b|\bclimate\b|\bsustainability\b|\becology\b"),
    ("economics", r"\beconomics\b|\bfinance\b"),
    ("business", r"\bbusiness\b|\bmanagement\b|\bcommerce\b"),
    ("law", r"\blaw\b|\blegal\b"),
    ("politics", r"\bpolitics\b|\bpolitical science\b|\binternational relations\b"),
    ("psychology", r"\bpsychology\b"),
    ("history", r"\bhistory\b"),
    ("literature", r"\bliterature\b|\bcreative writing\b|\bpoetry\b"),
    ("journalism", r"\bjournalism\b|\bmedia\b"),
]
COUNTRY_TERMS = [
    ("GB", r"\b(?:uk|united kingdom|britain|england|scotland|wales)\b"),
    ("US", r"\b(?:usa?|united states|america)\b"),
    ("IN", r"\bindia\b"),
    ("CA", r"\bcanada\b"),
    ("AU", r"\baustralia\b"),
    ("SG", r"\bsingapore\b"),
    ("AE", r"\b(?:uae|united arab emirates|dubai)\b"),
    ("DE", r"\bgermany\b"),
    ("FR", r"\bfrance\b"),
    ("NL", r"\bnetherlands\b|\bholland\b"),
    ("CH", r"\bswitzerland\b"),
    ("IE", r"\bireland\b"),
    ("NZ", r"\bnew zealand\b"),
    ("ZA", r"\bsouth africa\b"),
    ("NG", r"\bnigeria\b"),
    ("KE", r"\bkenya\b"),
    ("PK", r"\bpakistan\b"),
    ("BD", r"\bbangladesh\b"),
    ("JP", r"\bjapan\b"),
    ("KR", r"\b(?:south korea|korea)\b"),
    ("CN", r"\bchina\b"),
    ("BR", r"\bbrazil\b"),
]
MONTH_NAMES = "january february march april may june july august september october november december".split()
FILLER_WORDS = "find me show search looking for in the a an and or of to with that are is i am my want need students student opportunities opportunity programmes programs interested about any some good best near during old year years olds free online".split()

#: (first address, prefix length, reason) in order of evaluation.
BLOCKED_RANGES = [
    ("0.0.0.0", 8, "UNSPECIFIED"),
    ("127.0.0.0", 8, "LOOPBACK"),
    ("10.0.0.0", 8, "PRIVATE"),
    ("172.16.0.0", 12, "PRIVATE"),
    ("192.168.0.0", 16, "PRIVATE"),
    ("169.254.0.0", 16, "LINK_LOCAL"),
    ("100.64.0.0", 10, "CARRIER_GRADE_NAT"),
    ("192.0.0.0", 24, "RESERVED"),
    ("192.0.2.0", 24, "RESERVED"),
    ("198.18.0.0", 15, "RESERVED"),
    ("198.51.100.0", 24, "RESERVED"),
    ("203.0.113.0", 24, "RESERVED"),
    ("224.0.0.0", 4, "MULTICAST"),
    ("240.0.0.0", 4, "RESERVED"),
]
METADATA_ADDRESS = "169.254.169.254"
