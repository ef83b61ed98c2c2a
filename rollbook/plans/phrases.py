"""Phrases the classification rules look for in job titles and employer names.

Words must stand alone, phrases may occur anywhere in the folded text.
"""

# Employer label of each industry.
EMPLOYER_LABELS = {
    "consulting": "consulting_professional_services",
    "banking": "financial_services",
    "investment_banking": "financial_services",
    "finance": "financial_services",
    "venture_capital": "financial_services",
    "private_equity": "financial_services",
    "tech": "technology",
    "marketing": "marketing",
    "operations": "operations",
    "law": "law",
    "government_legal": "government_legal",
    "healthcare": "healthcare",
    "education": "education",
    "media": "media",
    "nonprofit": "nonprofit",
}

JOB_FUNCTIONS = {
    "consulting_advisory": ("consultant", "consulting", "advisory"),
    "finance_investing": (
        "investment banking", "investment banker", "m&a analyst", "mergers and acquisitions", "banker",
        "private equity", "portfolio manager", "trader", "trading", "equity research", "wealth management",
        "private wealth", "asset management", "hedge fund", "corporate finance", "capital markets",
        "sales and trading", "financial analyst", "financial advisor", "wealth advisor", "investment advisor",
        "investment analyst", "investment associate",
    ),
    "banking": (
        "corporate banking", "commercial banking", "credit analyst", "capital markets", "sales and trading",
        "equity research",
    ),
    "investment_banking": ("investment banking analyst", "investment banking associate", "investment banking", "investment banker"),
    "internal_strategy": ("strategy", "strategic planning", "chief of staff", "corporate development"),
    "product": (
        "product manager", "product management", "product lead", "product owner", "head of product",
        "chief product officer", "product strategy",
    ),
    "operations": (
        "operations manager", "business operations", "strategy and operations", "strategy & operations",
        "supply chain", "logistics", "revops", "revenue operations", "sales operations", "people operations",
        "clinical operations", "program operations", "operations analyst", "operations associate",
        "director of operations", "head of operations", "chief operating officer", "coo",
    ),
    "legal": ("attorney", "lawyer", "counsel", "law clerk", "paralegal", "judicial", "legal"),
    "engineering": (
        "software engineer", "software engineering", "engineer", "founding engineer", "forward deployed engineer", "research engineer",
        "developer", "programmer", "devops", "site reliability", "infrastructure", "technical lead", "cto",
    ),
    "data_analytics": (
        "data scientist", "data analyst", "data engineer", "database", "database management systems", "analytics",
        "analytics engineering", "data science",
    ),
    "sales_business_development": ("sales", "business development", "account executive", "partnerships"),
    "marketing": (
        "marketing manager", "marketing analyst", "product marketing", "brand manager", "advertising",
        "performance marketing", "demand generation", "lifecycle marketing", "seo", "sem", "content marketing",
        "digital marketing", "marketing coordinator", "marketing director", "head of marketing",
        "chief marketing officer", "cmo",
    ),
    "marketing_growth": ("growth marketing", "growth"),
    "communications_pr": ("communications manager", "public relations", "pr manager"),
    "government_policy": (
        "policy analyst", "legislative aide", "government analyst", "public policy analyst", "city planner",
        "federal analyst", "campaign staff",
    ),
    "education_teaching": ("teacher", "professor", "lecturer", "instructor", "educator"),
}

SPECIALTIES = {
    "management_consulting": ("management consultant", "management consulting"),
    "strategy_consulting": ("strategy consultant", "strategy consulting"),
    "technology_consulting": ("technology consultant", "technology consulting", "it consultant"),
    "implementation": ("implementation consultant", "implementation"),
    "risk_consulting": ("risk consulting", "risk consultant", "risk advisory"),
    "transaction_advisory": ("transaction advisory", "transaction services"),
    "deal_advisory": ("deal advisory",),
    "valuation": ("valuation",),
    "restructuring": ("restructuring",),
    "financial_advisory": ("financial advisory",),
    "corporate_strategy": ("corporate strategy", "head of strategy", "director of strategy"),
    "product_strategy": ("product strategy",),
    "business_operations": ("business operations", "strategy & operations", "strategy and operations"),
    "investment_banking": ("investment banking", "investment banker"),
    "m_and_a": ("m&a", "mergers and acquisitions"),
    "capital_markets": ("capital markets",),
    "private_equity": ("private equity",),
    "asset_management": ("asset management",),
    "wealth_management": ("wealth management", "private wealth"),
    "legal": ("attorney", "lawyer", "law clerk", "paralegal", "counsel", "judicial"),
    "risk": ("risk",),
    "marketing": ("marketing", "brand manager", "advertising", "demand generation", "product marketing"),
    "growth": ("growth marketing", "head of growth"),
    "operations": ("operations", "business operations", "supply chain", "logistics", "revenue operations"),
    "government_policy": ("policy analyst", "legislative", "government analyst", "public policy"),
}

# Specialties that relate a title to a required industry.
RELATED_SPECIALTIES = {
    "finance": (
        "risk", "risk_consulting", "transaction_advisory", "deal_advisory", "valuation", "restructuring",
        "financial_advisory", "investment_banking", "private_equity", "asset_management", "wealth_management",
    ),
    "banking": ("investment_banking", "transaction_advisory", "deal_advisory", "restructuring"),
    "tech": ("technology_consulting",),
}

TECHNICAL_TITLES = (
    "software engineer", "software engineering", "swe", "software developer", "cloud software engineer",
    "staff software engineer", "senior software engineer", "backend engineer", "front end engineer", "frontend engineer",
    "full stack engineer", "founding engineer", "founder software engineer", "forward deployed engineer",
    "research engineer", "ai research engineer", "data scientist", "data engineer", "database engineer",
    "database administrator", "database management systems", "machine learning engineer", "ml engineer", "ai engineer",
    "cloud engineer", "cloud support engineer", "security engineer", "cybersecurity analyst",
    "site reliability engineer", "devops engineer", "systems engineer", "solutions engineer",
    "client solutions engineer", "blockchain engineer", "ux engineer", "technical program manager",
    "technical product manager", "technical lead", "technical services", "it director", "cto",
    "chief technology officer", "data platform analyst", "analytics engineer", "analytics engineering",
    "infrastructure engineer", "product engineer", "security analyst", "quantitative developer", "seo product analyst",
)

TECH_ADJACENT_TITLES = (
    "product manager", "product management", "product lead", "product owner", "product strategy",
    "analytics manager", "decision analytics", "growth analytics", "sales analytics", "client insights",
    "business systems analyst", "systems analyst", "revops", "revenue operations", "customer success",
    "customer operations", "professional services", "implementation", "technology consultant",
    "technical consultant", "project management", "head of growth", "growth", "digital", "platform", "product",
)

TECH_EMPLOYER_WORDS = (
    "technologies", "technology", "software", "ai", "artificial intelligence", "cloud", "cybersecurity", "fintech",
    "blockchain", "crypto", "saas", "semiconductor", "satellite", "space technology", "data platform",
    "developer tools", "analytics", "analytics platform",
)

INVESTMENT_BANKING_TITLES = (
    "investment banking analyst", "investment banking associate", "investment banking", "investment banker",
)

BANKING_TITLES = (
    "banker", "corporate banking", "commercial banking", "credit analyst", "capital markets", "sales and trading",
    "wealth management", "private wealth", "strategic advisory", "restructuring",
)

FINANCE_TITLES = (
    "financial analyst", "finance", "portfolio manager", "asset management", "wealth management", "hedge fund",
    "trader", "trading", "quant", "quantitative researcher", "investment analyst", "investment associate",
    "research analyst", "equity research", "investment management", "investor", "private equity",
    "venture capital", "quantitative developer", "risk analyst",
)

MARKETING_TITLES = (
    "marketing manager", "marketing analyst", "growth marketing analyst", "growth marketing manager",
    "account strategist", "ads account strategist", "media planner", "brand strategist", "product marketing manager",
    "brand manager", "artist marketing manager", "communications manager", "advertising strategist",
    "performance marketing analyst", "demand generation manager", "lifecycle marketing manager", "seo manager",
    "sem manager", "content marketing manager", "digital marketing manager", "digital marketing associate",
    "digital marketing", "marketing coordinator", "marketing director", "head of marketing", "chief marketing officer",
    "cmo", "consumer insights analyst",
)

MARKETING_ADJACENT_TITLES = (
    "head of growth", "growth", "strategy", "community", "partnerships", "sales", "product", "business development",
    "customer success", "content", "brand", "communications",
)

OPERATIONS_TITLES = (
    "operations manager", "business operations", "strategy and operations", "strategy & operations",
    "marketplace operations analyst", "supply chain analyst", "supply chain manager", "logistics manager",
    "sales operations", "people operations", "clinical operations", "program operations", "operations analyst",
    "operations associate", "operations leadership associate", "director of operations", "head of operations",
    "manufacturing engineer", "logistics analyst", "revenue management analyst", "chief operating officer", "coo",
)

OPERATIONS_ADJACENT_TITLES = (
    "strategy", "business analyst", "business", "management", "program manager", "project manager",
    "product operations", "customer success", "general manager", "revops", "revenue operations", "analyst",
    "associate",
)

GOVERNMENT_LEGAL_TITLES = (
    "attorney", "lawyer", "legal counsel", "associate attorney", "law clerk", "judicial clerk", "paralegal", "counsel",
    "litigation associate", "corporate counsel", "legal assistant", "policy analyst", "legislative aide",
    "government analyst", "public policy analyst", "city planner", "federal analyst",
)

CLIENT_ADVISORY_TITLES = (
    "transaction advisory", "deal advisory", "valuation advisory", "restructuring advisory", "risk advisory",
    "technology advisory", "strategy advisory", "m&a advisory", "transaction services",
)

FINANCE_NOT_CONSULTING_TITLES = (
    "investment banking", "investment banker", "banker", "private equity", "portfolio manager", "trader",
    "equity research", "wealth management", "private wealth", "hedge fund", "capital markets", "corporate finance",
    "sales and trading", "asset management", "financial analyst", "financial advisor", "wealth advisor",
)

CONSULTING_ADJACENT_WORDS = ("strategy", "operations", "management", "manager", "transaction", "deal", "chief of staff")

# What a title says about the role, first match wins.
ROLE_SIGNALS = (
    ("technical", TECHNICAL_TITLES),
    ("product", ("product manager", "product management", "product lead", "product owner", "product strategy")),
    ("analytics", ("analytics", "data analyst", "decision analytics", "growth analytics", "sales analytics")),
    (
        "business",
        (
            "finance", "sales", "customer success", "business development", "account manager", "account executive",
            "strategy", "growth", "marketing", "operations", "legal", "counsel", "professional services",
        ),
    ),
    ("nontechnical", ("teacher", "physician", "doctor", "attorney", "law clerk")),
)

# What an employer label says about the employer, first match wins.
EMPLOYER_SIGNALS = (
    ("technology", "tech_company"),
    ("financial_services", "finance"),
    ("consulting_professional_services", "consulting"),
    ("healthcare", "healthcare"),
    ("education", "education"),
)
RESEARCH_EMPLOYER_WORDS = ("laboratory", "lab", "research")
