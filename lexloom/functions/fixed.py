"""Lists, tables and formats that results depend on. Stated plainly, without logic."""

from __future__ import annotations

# ---- fixed values: citations -------------------------------------------------------------------------------------

UK_COURTS = [
    "UKSC", "UKPC", "UKHL", "EWCA Civ", "EWCA Crim", "EWHC", "EWCOP", "EWFC", "EWCC", "UKUT", "UKFTT", "UKEAT", "EAT", "UKIAT", "UKAIT", "UKSIAC", "UKIPTrib",
    "CSIH", "CSOH", "HCJAC", "HCJ", "SAC (Civ)", "SAC (Crim)", "NICA", "NIKB", "NIQB", "NICh", "NIFam", "NICC", "NIMaster",
]
UK_DIVISIONS = ["Admin", "Admlty", "Ch", "Comm", "Costs", "Fam", "IPEC", "KB", "Mercantile", "Pat", "QB", "SCCO", "TCC", "B", "AAC", "GRC", "IAC", "LC", "PC", "TC"]
UK_SQUARE_REPORTS = [
    "AC", "QB", "KB", "Ch", "Fam", "P", "WLR", "All ER", "All ER (Comm)", "All ER (D)", "Lloyd's Rep", "Lloyd's Rep IR", "Lloyd's Rep PN", "Lloyd's Rep Med", "BCLC", "BCC",
    "Bus LR", "Cr App R", "Cr App R (S)", "Crim LR", "ICR", "IRLR", "EMLR", "RPC", "FSR", "P & CR", "HLR", "EGLR", "BLR", "Con LR", "CMLR", "Costs LR", "PNLR", "FLR", "FCR",
    "STC", "Env LR", "PIQR", "Med LR", "BMLR", "CLC", "WTLR", "UKHRR", "HRLR",
]
UK_ROUND_REPORTS = [
    "App Cas", "QBD", "Ch D", "PD", "Ex D", "CPD", "Exch", "HL Cas", "Ch App", "Cr App R", "Cr App R (S)", "EHRR", "P & CR", "HLR", "BMLR", "LGR", "TC", "EG", "Bing",
    "B & S", "E & B", "M & W", "H & N",
]
ECHR_REPORTS = ["EHRR"]
UK_LAW_REPORTS_SERIES = ["HL", "QB", "Ch", "CP", "Ex", "Eq", "PC", "Ch App", "A & E", "P & D"]
US_REPORTS = [
    "U.S.", "S. Ct.", "L. Ed.", "L. Ed. 2d", "F.", "F.2d", "F.3d", "F.4th", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "F. App'x", "B.R.", "Fed. Cl.", "A.2d", "A.3d",
    "P.2d", "P.3d", "N.E.", "N.E.2d", "N.E.3d", "N.W.", "N.W.2d", "S.E.", "S.E.2d", "S.W.", "S.W.2d", "S.W.3d", "So.", "So. 2d", "So. 3d",
    "Cal. Rptr.", "Cal. Rptr. 2d", "Cal. Rptr. 3d", "N.Y.S.", "N.Y.S.2d", "N.Y.S.3d",
]
US_CODES = {"USC": "U.S.C.", "USCA": "U.S.C.A.", "CFR": "C.F.R."}
EU_COURTS = {"C": "CJ", "T": "GC", "F": "CST"}
PROVISIONS = {
    "section": "s", "s": "s", "sections": "ss", "ss": "ss", "regulation": "reg", "reg": "reg", "regulations": "regs", "regs": "regs", "rule": "r", "r": "r", "rules": "rr", "rr": "rr",
    "article": "art", "art": "art", "articles": "arts", "arts": "arts", "schedule": "sch", "sch": "sch", "schedules": "schs", "schs": "schs", "paragraph": "para", "para": "para",
    "paragraphs": "paras", "paras": "paras",
}
ACT_ENDS = ["Act", "Regulations", "Rules", "Order", "Measure"]

#: Lower-case words within a party's name, and those of them that may end one.
PARTY_LINKS = "of the and for de la le du des van von der den di da plc ltd llp inc co on behalf ex parte t/a und".split()
PARTY_FORMS = ["plc", "ltd", "llp", "inc", "co"]
PARTY_ABBREVIATIONS = ["Ltd", "Co", "Inc", "Corp", "Bros", "No", "St", "Plc", "Mr", "Mrs", "Dr"]
PARTY_SUFFIXES = ["Inc", "Ltd", "LLC", "LLP", "Co", "Corp", "N.A", "P.C", "L.L.C", "L.P", "S.A", "plc"]
#: Words that open a sentence or clause before a party or an Act.
CLAUSE_OPENERS = (
    "a accordingly after also although an and applied applying approved approving as at before both but by cf cited citing compare considered considering contrast distinguished "
    "distinguishing e.g eg either finally followed following for from further furthermore he hence her here his however i ie in indeed it its later likewise like moreover neither notably "
    "of on our overruled overruling per quoted quoting recently see she similarly since that the their then there therefore these they this those thus to under unlike we when where while yet you"
).split()
BEFORE_THE = ["of", "for", "to", "from", "by", "in", "on", "with", "at", "into", "upon"]

# ---- fixed values: personal data ---------------------------------------------------------------------------------

SHORT_TITLES = ["Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Rev", "Revd"]
LONG_TITLES = ["Miss", "Professor", "Sir", "Dame", "Lord", "Lady"]
LOWER_TITLES = ["mr", "mrs"]
LEGAL_ROLES = ["claimant", "defendant", "appellant", "respondent", "applicant", "plaintiff", "petitioner", "court", "tribunal", "judge", "justice", "barrister", "solicitor", "counsel", "witness", "expert"]
#: Roles that a person may bear as a name.
ROLE_NAMES = ["judge", "justice"]
NAME_ENDS = (
    "date dated signed signature address tel telephone email fax mobile statement exhibit schedule clause section part paragraph partner director associate secretary manager chairman chair officer "
    "consultant clerk trustee trustees executor executors administrator administrators receiver liquidator limited ltd plc llp llc inc company co corporation madam"
).split()
POST_NOMINALS = "qc kc sc cbe obe mbe kbe dbe gbe mp mep msp jp frcs frcp mrcs mrcp phd dphil llb llm bcl mr lj ljj jj cj vc psc dpsc jsc".split()
FUNCTION_WORDS = "the this that these those and nor but if of at as by for from with into upon is was are were has had it its we they them their our his me us v vs re via in".split()
NAME_LIKE_FUNCTION_WORDS = ["per", "to", "on", "or", "my"]
LINE_OPENERS = "dear yours thank thanks please regarding subject further following yes no note instructed head he she you an".split()
OFFICES = ["justice", "justices", "speaker", "president"]
LORD_OFFICES = "chief chancellor advocate president ordinary mayor lieutenant speaker privy high provost chamberlain steward commissioner commissioners warden great bishop day".split()
NAME_PARTICLES = "van von de da di du del della der den la le al el bin ibn ap ter ten dos das".split()

LEGAL_FORMS = [
    "Limited", "LIMITED", "Ltd", "LTD", "plc", "PLC", "Inc", "INC", "LLC", "LLP", "L.L.P", "Corporation", "CORPORATION", "Corp", "CORP", "Company", "COMPANY", "Co", "CO",
    "GmbH", "AG", "SA", "S.A", "NV", "N.V", "BV", "B.V", "SE", "LP", "L.P",
]
UNSURE_LEGAL_FORMS = "corporation corp ag sa se nv bv lp".split()
COMPANY_FORMS = ["company", "co"]
COMPANY_LINKS = ["and", "of", "the", "for", "de", "du"]
COMPANY_OPENERS = (
    "a after also although an and as at because before between but by dear during for from further furthermore however if in it its meanwhile moreover of on our re since so that the their then "
    "there these this those to under when where whereas which while with yesterday today your"
).split()
JOB_TITLES = (
    "board chair chairman chairwoman chief company director directors employee employees executive finance general head managing manager member members officer partner president secretary shareholder shareholders"
).split()
PUBLIC_BODIES = ["court", "tribunal", "parliament", "house of lords", "privy council", "commission", "government", "ministry", "department", "crown", "secretary of state"]

COURT_KINDS = [
    "High", "Crown", "County", "Supreme", "Magistrates", "Family", "Divisional", "Commercial", "Admiralty", "Chancery", "Coroner", "Coroners", "Youth", "Circuit", "District", "Appeal", "Appeals",
    "Tax", "Employment", "Upper", "Business", "Property", "Patents",
]
STREETS = [
    "Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Court", "Ct", "Place", "Pl", "Square", "Sq", "Gardens", "Gdns", "Crescent", "Cres", "Way", "Close", "Terrace",
    "Grove", "Hill", "Park", "Row", "Mews", "Walk", "Parade", "Rise", "View", "Green", "Boulevard", "Blvd", "Wharf", "Quay", "Yard", "Circus",
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ENTITY_TYPES = ("person", "organisation", "address", "email", "phone", "date", "money", "account_number", "national_id", "case_number")

# ---- fixed values: sentences -------------------------------------------------------------------------------------

ABBREVIATIONS = (
    "v vs mr mrs ms dr prof no nos s ss para paras art arts reg regs sch ch pt cl e.g i.e etc ltd co inc corp plc st cf viz al op cit ibid id ed eds vol p pp n nn fn j lj cj jj rt hon esq sec secs subs"
).split()

# ---- fixed values: measures --------------------------------------------------------------------------------------

TERMS = {
    "uk": [
        "claimant", "defendant", "appellant", "respondent", "tort", "breach", "duty of care", "negligence", "statute", "regulation", "precedent", "ratio decidendi", "obiter dicta", "judicial review",
        "injunction", "damages", "liability", "indemnity", "warranty", "covenant", "consideration", "estoppel", "ultra vires",
    ],
    "us": [
        "plaintiff", "defendant", "appellant", "appellee", "tort", "breach", "due process", "negligence", "statute", "regulation", "precedent", "stare decisis", "dicta", "certiorari", "injunction",
        "damages", "liability", "indemnification", "warranty", "covenant", "consideration", "estoppel", "preemption", "standing",
    ],
    "eu": [
        "applicant", "defendant", "appellant", "member state", "directive", "regulation", "decision", "preliminary ruling", "proportionality", "subsidiarity", "direct effect", "supremacy",
        "infringement", "annulment", "preliminary reference", "advocate general",
    ],
}
HEDGES = [
    "may", "might", "could", "possibly", "potentially", "it appears", "it seems", "arguably", "generally", "in some cases", "typically", "usually", "often", "subject to", "depending on",
    "it is possible",
]

# ---- fixed values: jurisdictions ---------------------------------------------------------------------------------

JURISDICTION_NAMES = {"uk": "United Kingdom", "us": "United States", "eu": "European Union"}
JURISDICTION_TERMS = {
    "uk": [
        "claimant", "defendant", "appellant", "respondent", "applicant", "petitioner", "court", "tribunal", "hearing", "judgment", "order", "injunction", "stay", "appeal", "judicial review",
        "tort", "contract", "negligence", "breach", "duty of care", "causation", "remoteness", "damages", "liability", "indemnity", "warranty", "covenant", "consideration",
        "precedent", "ratio decidendi", "obiter dicta", "stare decisis", "ultra vires", "estoppel", "laches", "equity",
        "statute", "regulation", "statutory instrument", "act", "schedule", "section", "subsection", "paragraph",
        "solicitor", "barrister", "counsel", "judge", "justice", "magistrate", "tribunal member",
    ],
    "us": [
        "plaintiff", "defendant", "appellant", "appellee", "petitioner", "respondent", "court", "hearing", "opinion", "order", "judgment", "injunction", "stay", "appeal", "certiorari", "mandamus",
        "tort", "contract", "negligence", "breach", "duty", "causation", "damages", "liability", "indemnification", "warranty", "covenant", "consideration",
        "due process", "equal protection", "commerce clause", "first amendment", "fourth amendment", "fifth amendment",
        "precedent", "stare decisis", "dicta", "holding", "preemption", "standing", "mootness", "ripeness",
        "statute", "regulation", "code", "section", "subsection", "attorney", "counsel", "judge", "justice", "magistrate",
    ],
    "eu": [
        "applicant", "defendant", "member state", "commission", "council", "parliament", "advocate general", "court of justice", "general court", "preliminary ruling", "preliminary reference",
        "infringement", "annulment", "opinion", "judgment", "order", "proportionality", "subsidiarity", "direct effect", "indirect effect", "supremacy", "consistent interpretation",
        "state liability", "effectiveness", "equivalence", "regulation", "directive", "decision", "recommendation", "treaty", "charter", "data subject", "controller", "processor", "personal data",
        "processing", "consent", "legitimate interest", "data protection impact assessment", "supervisory authority", "undertaking", "dominant position", "abuse", "merger", "concentration", "state aid",
    ],
}
COURT_RANKS = {
    "uk": ["Supreme Court", "Privy Council", "Court of Appeal", "High Court", "Crown Court", "County Court", "Magistrates' Court", "Tribunal"],
    "us": ["Supreme Court", "Court of Appeals", "Circuit Court", "District Court", "Bankruptcy Court", "Magistrate"],
    "eu": ["Court of Justice", "General Court"],
}
COURT_ALIASES = {
    "uk": {
        "UKSC": "Supreme Court", "UKHL": "Supreme Court", "House of Lords": "Supreme Court", "UKPC": "Privy Council", "EWCA Civ": "Court of Appeal", "EWCA Crim": "Court of Appeal", "EWHC": "High Court",
        "EWCOP": "High Court", "EWCC": "County Court", "UKUT": "Tribunal", "UKFTT": "Tribunal", "UKEAT": "Tribunal", "EAT": "Tribunal",
    },
    "us": {"SCOTUS": "Supreme Court"},
    "eu": {"CJ": "Court of Justice", "CJEU": "Court of Justice", "ECJ": "Court of Justice", "GC": "General Court", "CFI": "General Court"},
}

# ---- fixed values: prompts and folders ---------------------------------------------------------------------------

ALPACA_WITH_CONTEXT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Input:\n{context}\n\n### Response:\n"
ALPACA_PLAIN = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:\n"
FOLDER_TYPES = {
    "contract": "contract", "contracts": "contract", "agreements": "contract", "case": "case", "cases": "case", "judgment": "case", "judgments": "case", "judgement": "case", "judgements": "case",
    "legislation": "legislation", "statutes": "legislation", "regulations": "legislation",
}
