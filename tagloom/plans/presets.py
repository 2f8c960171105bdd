"""Fixed values of the posting domain: word lists, patterns, rules, field mappings.

Everything in this module is data that must equal the domain's definition for the
results to be right. The operators take it as arguments.
"""

from __future__ import annotations

from tagloom.functions.rules import Keyword, Rule, any_of, at_least

# --- Fixed values: canonical tag names by category, in display order -----------------

CATEGORIES: dict[str, list[str]] = {
    "languages": [
        "Python", "Java", "TypeScript", "JavaScript", "C#", "Go",
        "SQL", "Kotlin", "Swift", "Rust",
        "Ruby", "PHP", "Scala", "Dart", "R", "Elixir", "C++",
    ],
    "frontend": [
        "React", "Next.js", "Angular", "Vue", "Tailwind", "Redux", "Svelte",
        "Vite", "tRPC", "Remix", "Storybook",
    ],
    "backend": [
        "Spring Boot", "Node.js", "Express", "NestJS", ".NET",
        "Django", "FastAPI", "GraphQL", "REST", "gRPC",
        "Rails", "Laravel", "Flask", "ASP.NET", "Celery", "Gin",
    ],
    "databases": [
        "PostgreSQL", "MySQL", "MongoDB", "Redis",
        "DynamoDB", "Snowflake", "Elasticsearch", "ClickHouse",
        "BigQuery", "Cassandra", "Firebase", "Supabase", "SQLite",
    ],
    "cloud": [
        "AWS", "Azure", "GCP", "Linux", "Nginx", "Cloudflare",
        "Vercel", "DigitalOcean", "Heroku",
    ],
    "devops": [
        "Docker", "Kubernetes", "Terraform", "Helm",
        "GitHub Actions", "Jenkins", "ArgoCD",
        "Prometheus", "Grafana", "Ansible",
        "GitLab CI", "CircleCI", "Pulumi", "Vault",
    ],
    "data_ai": [
        "Pandas", "Spark", "Databricks", "Airflow",
        "TensorFlow", "PyTorch", "LangChain", "OpenAI",
        "Vector DB", "dbt", "Kafka", "MLflow",
        "NumPy", "scikit-learn", "Hugging Face", "Flink", "RabbitMQ", "Weights & Biases",
    ],
    "mobile": ["React Native", "Flutter", "SwiftUI", "Android", "iOS"],
    "testing": [
        "Jest", "Cypress", "Playwright", "Selenium", "JUnit", "Postman",
        "Vitest", "pytest", "Mocha", "RSpec",
    ],
    "ai_concepts": [
        "LLM", "RAG",
        "AI Agents", "Prompt Engineering", "Fine-tuning", "Embeddings",
        "Semantic Search", "NLP", "Computer Vision", "GenAI",
    ],
}

# Trend charts show the category "data_ai" under this name.
DISPLAY_CATEGORY = {"data_ai": "data"}

DEFAULT_CATEGORIES = ["languages", "frontend", "devops", "data"]

SEGMENT_CATEGORIES = {
    "startup_saas": ["frontend", "backend", "databases", "languages"],
    "enterprise": ["languages", "backend", "databases", "cloud"],
    "ai_ml": ["data", "ai_concepts", "languages", "cloud"],
    "cloud_platform": ["cloud", "devops", "backend", "databases"],
    "consulting": ["languages", "backend", "frontend", "databases"],
    "fintech": ["languages", "backend", "databases", "devops"],
    "mobile": ["mobile", "languages", "frontend", "backend"],
}

# Categories whose tags are shown first on a row.
DISTINCTIVE_FIRST = [
    "languages", "ai_concepts", "databases", "mobile", "frontend",
    "backend", "data", "testing", "other", "devops", "cloud",
]

# --- Fixed values: keyword dictionary (tag, pattern) ----------------------------------

_EXACT = True  # case-sensitive entry

KEYWORDS: list[Keyword] = [
    # languages
    Keyword("Python", r"Python"),
    Keyword("JavaScript", r"JavaScript"),
    Keyword("TypeScript", r"TypeScript"),
    Keyword("Go", r"\b(?:Go|Golang)\b", _EXACT),
    Keyword("Rust", r"Rust"),
    Keyword("Java", r"Java"),
    Keyword("Kotlin", r"Kotlin"),
    Keyword("Scala", r"Scala"),
    Keyword("C#", r"C#"),
    Keyword("C++", r"C\+\+"),
    Keyword("Ruby", r"Ruby"),
    Keyword("PHP", r"PHP"),
    Keyword("Swift", r"Swift"),
    Keyword("Dart", r"Dart"),
    Keyword("Elixir", r"Elixir"),
    Keyword("Erlang", r"Erlang"),
    Keyword("R", r"\bR\b", _EXACT),
    Keyword("SQL", r"\bSQL\b", _EXACT),
    # web
    Keyword("React", r"React"),
    Keyword("Next.js", r"Next\.js"),
    Keyword("Vue", r"Vue(?:\.js)?"),
    Keyword("Angular", r"Angular"),
    Keyword("Svelte", r"Svelte"),
    Keyword("Node.js", r"Node(?:\.js)?"),
    Keyword("Express", r"Express"),
    Keyword("GraphQL", r"GraphQL"),
    Keyword("REST", r"REST(?:ful)?", _EXACT),
    Keyword("Tailwind", r"Tailwind(?:\s+CSS)?"),
    Keyword("Redux", r"Redux"),
    Keyword("Vite", r"Vite", _EXACT),
    Keyword("tRPC", r"tRPC", _EXACT),
    Keyword("Remix", r"Remix"),
    Keyword("Storybook", r"Storybook"),
    # server frameworks
    Keyword("Django", r"Django"),
    Keyword("FastAPI", r"FastAPI"),
    Keyword("Flask", r"Flask"),
    Keyword("Rails", r"(?:Ruby on )?Rails"),
    Keyword("Spring Boot", r"Spring(?:\s+Boot)?"),
    Keyword("NestJS", r"NestJS"),
    Keyword("gRPC", r"gRPC"),
    Keyword("Celery", r"Celery"),
    Keyword("Laravel", r"Laravel"),
    Keyword("ASP.NET", r"ASP\.NET"),
    Keyword(".NET", r"\.NET"),
    Keyword("Gin", r"Gin", _EXACT),
    # data
    Keyword("Spark", r"(?:Apache )?Spark"),
    Keyword("Kafka", r"(?:Apache )?Kafka"),
    Keyword("Airflow", r"(?:Apache )?Airflow"),
    Keyword("Flink", r"(?:Apache )?Flink"),
    Keyword("dbt", r"dbt"),
    Keyword("Pandas", r"Pandas"),
    Keyword("NumPy", r"NumPy"),
    Keyword("PyTorch", r"PyTorch"),
    Keyword("TensorFlow", r"TensorFlow"),
    Keyword("scikit-learn", r"scikit-learn"),
    Keyword("Databricks", r"Databricks"),
    Keyword("RabbitMQ", r"RabbitMQ"),
    Keyword("LLM", r"LLM", _EXACT),
    Keyword("RAG", r"RAG", _EXACT),
    Keyword("LangChain", r"LangChain"),
    Keyword("OpenAI", r"OpenAI", _EXACT),
    Keyword("MLflow", r"MLflow"),
    Keyword("Vector DB", r"(?:Pinecone|Qdrant|Weaviate|Chroma|vector\s+(?:database|store|DB))"),
    Keyword("Hugging Face", r"(?:Hugging\s+Face|HuggingFace)"),
    Keyword("Weights & Biases", r"Weights\s+(?:&|and)\s+Biases"),
    # infrastructure
    Keyword("AWS", r"AWS"),
    Keyword("GCP", r"GCP"),
    Keyword("Azure", r"Azure"),
    Keyword("Vercel", r"Vercel"),
    Keyword("DigitalOcean", r"DigitalOcean"),
    Keyword("Heroku", r"Heroku"),
    Keyword("Kubernetes", r"Kubernetes"),
    Keyword("Docker", r"Docker"),
    Keyword("Terraform", r"Terraform"),
    Keyword("Ansible", r"Ansible"),
    Keyword("CI/CD", r"CI/CD"),
    Keyword("GitHub Actions", r"GitHub Actions"),
    Keyword("GitLab CI", r"GitLab\s+CI(?:/CD)?"),
    Keyword("CircleCI", r"CircleCI"),
    Keyword("Jenkins", r"Jenkins"),
    Keyword("Helm", r"Helm"),
    Keyword("ArgoCD", r"Argo\s*CD"),
    Keyword("Pulumi", r"Pulumi"),
    Keyword("Prometheus", r"Prometheus"),
    Keyword("Grafana", r"Grafana"),
    Keyword("Nginx", r"Nginx"),
    Keyword("Cloudflare", r"Cloudflare"),
    Keyword("Vault", r"(?:HashiCorp\s+)?Vault", _EXACT),
    # databases
    Keyword("PostgreSQL", r"Postgres(?:QL)?"),
    Keyword("MySQL", r"MySQL"),
    Keyword("MongoDB", r"MongoDB"),
    Keyword("Redis", r"Redis"),
    Keyword("Elasticsearch", r"Elasticsearch"),
    Keyword("Snowflake", r"Snowflake"),
    Keyword("BigQuery", r"BigQuery"),
    Keyword("DynamoDB", r"DynamoDB"),
    Keyword("Cassandra", r"Cassandra"),
    Keyword("ClickHouse", r"ClickHouse"),
    Keyword("Firebase", r"Firebase"),
    Keyword("Supabase", r"Supabase"),
    Keyword("SQLite", r"SQLite"),
    # mobile
    Keyword("Android", r"Android"),
    Keyword("iOS", r"iOS"),
    Keyword("React Native", r"React Native"),
    Keyword("Flutter", r"Flutter"),
    Keyword("SwiftUI", r"SwiftUI"),
    # testing
    Keyword("Jest", r"Jest"),
    Keyword("Vitest", r"Vitest"),
    Keyword("Cypress", r"Cypress"),
    Keyword("Playwright", r"Playwright"),
    Keyword("Selenium", r"Selenium"),
    Keyword("JUnit", r"JUnit"),
    Keyword("pytest", r"pytest"),
    Keyword("Mocha", r"Mocha"),
    Keyword("RSpec", r"RSpec"),
    Keyword("Postman", r"Postman"),
    # AI concepts
    Keyword("AI Agents", r"(?:AI\s+agents?|agentic(?:\s+AI)?|agents?\s+IA)"),
    Keyword("Prompt Engineering", r"(?:prompt\s+engineering|ing[eé]nierie\s+(?:de\s+)?prompts?)"),
    Keyword("Fine-tuning", r"(?:fine[-\s]?tuning|finetuning)"),
    Keyword("Embeddings", r"(?:vector\s+)?embeddings"),
    Keyword("Semantic Search", r"(?:semantic\s+search|recherche\s+s[eé]mantique)"),
    Keyword("NLP", r"NLP", _EXACT),
    Keyword("NLP", r"(?:natural\s+language\s+processing|traitement\s+du\s+langage\s+naturel)"),
    Keyword("Computer Vision", r"(?:computer\s+vision|vision\s+par\s+ordinateur)"),
    Keyword("GenAI", r"(?:GenAI|generative\s+AI|IA\s+g[eé]n[eé]rative)"),
]

# Tags that the dictionary of the markdown-table source knows.
TABLE_SOURCE_TAGS = [
    "Python", "JavaScript", "TypeScript", "Go", "Rust", "Java", "Kotlin", "Scala", "C#", "C++",
    "Ruby", "PHP", "Swift", "SQL", "React", "Next.js", "Vue", "Angular", "Node.js", "Tailwind",
    "Redux", "Django", "FastAPI", "Spring Boot", "NestJS", ".NET", "AWS", "GCP", "Azure",
    "Kubernetes", "Docker", "Jenkins", "Helm", "ArgoCD", "Prometheus", "Grafana", "Nginx",
    "Cloudflare", "LangChain", "OpenAI", "MLflow", "Vector DB", "PostgreSQL", "MySQL", "MongoDB",
    "React Native", "Flutter", "SwiftUI", "Jest", "Cypress", "Playwright", "Selenium", "JUnit",
    "Postman",
]


def dictionary(tags: list[str]) -> list[Keyword]:
    """The keyword entries of the given tags, in the order of ``tags``."""
    by_tag: dict[str, list[Keyword]] = {}
    for entry in KEYWORDS:
        by_tag.setdefault(entry.tag, []).append(entry)
    return [entry for tag in tags for entry in by_tag[tag]]


# One source lists the two mobile platforms after the mobile frameworks.
PLATFORMS_LAST = [k for k in KEYWORDS if k.tag not in ("Android", "iOS")]
_at = [k.tag for k in PLATFORMS_LAST].index("SwiftUI") + 1
PLATFORMS_LAST[_at:_at] = dictionary(["Android", "iOS"])


# --- Fixed values: first-match rules ---------------------------------------------------

REGION_PATTERN = (
    r"(?i)(montr[eé]al|qu[eé]bec|laval|longueuil|brossard|sherbrooke|gatineau|\bqc\b)"
)
WIDE_REGION_PATTERN = (
    r"(?i)(montr[eé]al|qu[eé]bec|laval|longueuil|brossard|sherbrooke|gatineau"
    r"|saint-jean|terrebonne|\bqc\b)"
)

REGION_RULES = [Rule("location", REGION_PATTERN, True)]
WIDE_REGION_RULES = [Rule("location", WIDE_REGION_PATTERN, True)]


def _seniority_rules(manager: str) -> list[Rule]:
    return [
        Rule("title", r"(?i)\b(intern|stage|stagiaire|internship)\b", "internship"),
        Rule("title", r"(?i)\b(junior|jr\.?|d[eé]butant)\b", "junior"),
        Rule("title", r"(?i)\b(staff)\b", "staff"),
        Rule("title", r"(?i)\b(principal)\b", "principal"),
        Rule("title", r"(?i)\b(tech(nical)?\s+lead|lead\s+(dev|engineer))\b", "lead"),
        Rule("title", r"(?i)\b(senior|sr\.?|exp[eé]riment[eé])\b", "senior"),
        Rule("title", r"(?i)\b(director|directeur)\b", "director"),
        Rule("title", manager, "manager"),
    ]


SENIORITY_RULES = _seniority_rules(r"(?i)\b(manager|gestionnaire)\b")
WIDE_SENIORITY_RULES = _seniority_rules(r"(?i)\b(manager|gestionnaire|responsable)\b")

WORKPLACE_RULES = {
    "greenhouse": [
        Rule("location", r"(?i)\bhybrid(e)?\b", None),
        Rule("location", r"(?i)\bremote\b", True),
        Rule("location", r"(?i)\b(on.?site|in.?office|pr[eé]sentiel|bureau)\b", False),
        Rule("title", r"(?i)\bremote\b", True),
    ],
    "lever": [
        Rule("_workplace_type", r"(?i)^remote$", True),
        Rule("_workplace_type", r"(?i)^hybrid$", None),
        Rule("_workplace_type", r"(?i)^on.?site$", False),
        Rule("location", r"(?i)\bremote\b", True),
    ],
    "workable": [
        Rule("location", r"(?i)\(remote\)", True),
        Rule("location", r"(?i)\(hybrid\)", None),
        Rule("location", r"(?i)\(on.?site\)", False),
    ],
    "workday": [
        Rule("location", r"(?i)\bhybrid(e)?\b", None),
        Rule("location", r"(?i)\bremote\b", True),
        Rule("location", r"(?i)\b(on.?site|in.?office|pr[eé]sentiel)\b", False),
        Rule("title", r"(?i)\bremote\b", True),
    ],
}

EMPLOYMENT_RULES = {
    "greenhouse": [
        Rule("title", r"(?i)\b(intern|stage|stagiaire)\b", "internship"),
        Rule("title", r"(?i)\b(contract|contractuel|freelance)\b", "contract"),
        Rule("title", r"(?i)\b(part.?time|temps\s+partiel)\b", "part-time"),
    ],
    "lever": [
        Rule("_commitment", r"(?i)full.?time", "full-time"),
        Rule("_commitment", r"(?i)part.?time", "part-time"),
        Rule("_commitment", r"(?i)(contract|consultant|fixed.?term)", "contract"),
        Rule("_commitment", r"(?i)(intern|stage|stagiaire)", "internship"),
    ],
    "workable": [
        Rule("_employment_raw", r"(?i)full.?time", "full-time"),
        Rule("_employment_raw", r"(?i)part.?time", "part-time"),
        Rule("_employment_raw", r"(?i)(contract|temp)", "contract"),
        Rule("_employment_raw", r"(?i)(intern|stage)", "internship"),
    ],
    "workday": [],
}

# --- Fixed values: titles outside technical work (case-insensitive, whole words) ---------

NON_TECH_TITLE = (
    r"(?i)\b("
    r"paralegal|parajuriste"
    r"|legal\s+counsel|conseill(?:er|ère)\s+juridique|avocat(?:e)?"
    r"|notary|notaire"
    r"|recruiter|recruteur(?:euse)?|talent\s+acquisition"
    r"|human\s+resources|ressources?\s+humaines"
    r"|hr\s+(?:manager|generalist|coordinator|business\s+partner)"
    r"|marketing\s+(?:coordinator|manager|specialist|analyst|director)"
    r"|coordonnateur(?:trice)?\s+marketing"
    r"|media\s+(?:manager|buyer|planner|specialist|strategist)"
    r"|gestionnaire\s+des?\s+m[eé]dias"
    r"|responsable\s+(?:marketing|m[eé]dias|communication|contenu)"
    r"|sp[eé]cialiste\s+(?:marketing|m[eé]dias|publicit[eé]|communication)"
    r"|direct(?:eur|rice)\s+(?:marketing|m[eé]dias|communication)"
    r"|achet(?:eur|euse)\s+m[eé]dias|planificat(?:eur|rice)\s+m[eé]dias"
    r"|sales\s+(?:representative|rep|executive|manager|director|coordinator)"
    r"|account\s+executive|account\s+manager"
    r"|représentant(?:e)?\s+(?:des\s+ventes|commercial(?:e)?)"
    r"|finance\s+(?:manager|analyst|director|coordinator)"
    r"|accountant|comptable|controller|bookkeeper"
    r"|administrative\s+(?:assistant|coordinator)|assistant(?:e)?\s+administratif(?:ve)?"
    r"|receptionist|réceptionniste"
    r"|nurs(?:e|ing)|infirmi(?:er|ère)|pharmacist|pharmacien(?:ne)?"
    r"|teaching\s+assistant|assistant(?:e)?\s+d'enseignement"
    r"|professor|professeur(?:e)?|lecturer|charg[eé](?:e)?\s+de\s+cours"
    r"|librarian|biblioth[eé]caire"
    r"|structural\s+engineer|civil\s+engineer|environmental\s+engineer|geotechnical\s+engineer"
    r"|transportation\s+engineer"
    r"|ing[eé]nieur(?:e)?\s+(?:en\s+)?"
    r"(?:structure|civil(?:e)?|environnement(?:al)?|g[eé]otechnique)"
    r"|wealth\s+(?:advisor|manager|management)|financial\s+advisor|investment\s+advisor"
    r"|insurance\s+advisor|portfolio\s+manager|investment\s+analyst"
    r"|conseill(?:er|ère)\s+(?:en\s+)?"
    r"(?:gestion\s+de\s+patrimoine|financi(?:er|ère)|placement|assurance)"
    r"|actuary|actuaire|underwrit(?:er|ing)|souscripteur(?:trice)?"
    r"|claims\s+(?:adjuster|analyst|specialist)|branch\s+manager|teller|caissier(?:ère)?"
    r"|gestionnaire\s+(?:en\s+)?marketing"
    r"|agent(?:[(./·][\wÀ-ÿ]*\)?)?\s+(?:de\s+)?m[eé]thodes"
    r"|concepteur(?:[(./·][\wÀ-ÿ]*\)?)?\s+cabine|cabin\s+designer"
    r"|pr[eé]pos[eé](?:e)?|warehouse\s+(?:attendant|associate|worker)|entrep[oô]t"
    r"|client\s+financial\s+services|financial\s+services\s+agent"
    r"|advisor,\s*(?:personal|corporate)|internal\s+audit|corporate\s+accounting"
    r")\b"
)

# --- Fixed values: title language ----------------------------------------------------------

FRENCH_ACCENTS = "àâäçéèêëîïôöûüùœ"
ENGLISH_TITLE_WORDS = [
    "engineer", "engineering", "developer", "specialist", "architect",
    "consultant", "coordinator", "administrator", "representative",
    "assistant", "associate", "officer", "scientist", "designer", "owner",
    "technician", "recruiter", "accountant", "supervisor", "advisor", "clerk",
]
FRENCH_TITLE_WORDS = [
    "stagiaire", "adjoint", "adjointe", "analyste", "programmeur",
    "programmeuse", "responsable", "gestionnaire",
]

# --- Fixed values: posting urls ----------------------------------------------------------

POSTING_URLS = [
    ("lever", r"(?:jobs\.lever\.co|api\.lever\.co/v0/postings)/([^/]+)/([^/?]+)"),
    (
        "greenhouse",
        r"(?:job-boards(?:\.eu)?\.greenhouse\.io|boards-api\.greenhouse\.io/v1/boards)"
        r"/([^/]+)/jobs/([^/?]+)",
    ),
    ("workable", r"apply\.workable\.com/([^/]+)/j/([^/?]+)"),
]

# --- Fixed values: segments in priority order ---------------------------------------------

_AI_TOOLS = (
    "PyTorch", "TensorFlow", "Databricks", "MLflow", "LangChain",
    "OpenAI", "Vector DB", "RAG", "LLM",
)
_INFRA_TOOLS = (
    "Kubernetes", "Terraform", "Docker", "AWS", "GCP", "GitHub Actions",
    "Helm", "ArgoCD", "Prometheus", "Grafana", "Jenkins", "Ansible",
)

SEGMENTS = [
    (
        "mobile",
        [
            [any_of("React Native", "Flutter", "SwiftUI")],
            [any_of("iOS"), any_of("Swift")],
            [any_of("Android"), any_of("Kotlin")],
        ],
    ),
    ("fintech", [[any_of("Java", "Kotlin"), any_of("Kafka")]]),
    ("ai_ml", [[any_of("Python"), any_of(*_AI_TOOLS)], [at_least(2, *_AI_TOOLS)]]),
    ("cloud_platform", [[at_least(2, *_INFRA_TOOLS)]]),
    ("consulting", [[any_of(".NET", "C#"), any_of("Angular")]]),
    (
        "enterprise",
        [
            [
                any_of("Java", "Spring Boot"),
                any_of("AWS", "Azure", "GCP"),
                any_of("SQL", "PostgreSQL", "MySQL"),
            ]
        ],
    ),
    (
        "startup_saas",
        [
            [
                any_of("React", "Next.js", "Vue", "Svelte"),
                any_of("Node.js", "Express", "NestJS", "FastAPI", "Django"),
            ]
        ],
    ),
]

# --- Fixed values: labels of saved filters, board columns ----------------------------------

SENIORITY_LABELS = {
    "internship": "Intern",
    "junior": "Junior",
    "senior": "Senior",
    "lead": "Lead",
    "staff": "Staff",
    "principal": "Principal",
    "manager": "Manager",
    "director": "Director",
}
WORKPLACE_LABELS = {"true": "Remote", "false": "On-site", "null": "Hybride / Non spécifié"}
BOARD_COLUMNS = ["watching", "applied", "interviewing", "archived"]

# Sources whose rows are sent to enrichment.
ENRICHED_SOURCES = ["greenhouse", "lever", "workable"]

PAGE_SIZE = 30
SEARCH_LIMIT = 10
STALE_AFTER_HOURS = 36


def category_of() -> dict[str, str]:
    """Tag to display category."""
    return {
        tag: DISPLAY_CATEGORY.get(category, category)
        for category, tags in CATEGORIES.items()
        for tag in tags
    }
