"""Anchoring, keyword tags, first-match rules, title gate, segments, evidence."""

import random
import re

import pytest
from helpers import values
from pyspark.sql import functions as F

from tagloom.functions import patterns, rules
from tagloom.functions.rules import Keyword, Rule, first_match, keyword_evidence, segment, with_keyword_tags
from tagloom.plans import presets
from tagloom.plans.postings import is_non_tech_title


def tags_of(spark, texts, dictionary=presets.KEYWORDS):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tagged = with_keyword_tags(frame, ["t"], dictionary, "tags")
    return [r.tags for r in tagged.orderBy("i").collect()]


@pytest.mark.parametrize(
    "pattern, anchored",
    [
        ("Java", r"\bJava\b"),
        (r"C\+\+", r"\bC\+\+"),
        (r"\.NET", r"\.NET\b"),
        (r"\bR\b", r"\bR\b"),
        ("(?:Go|Golang)", r"\b(?:Go|Golang)\b"),
        (r"Node(?:\.js)?", r"\bNode(?:\.js)?\b"),
        ("(?:one|two(?:x|y))", r"\b(?:one|two(?:x|y))"),
    ],
)
def test_anchoring(pattern, anchored):
    assert patterns.whole_word(pattern) == anchored


def test_dictionary_sizes():
    assert len(presets.KEYWORDS) == 125
    assert len(presets.dictionary(presets.TABLE_SOURCE_TAGS)) == 54
    assert sum(map(len, presets.CATEGORIES.values())) == 123
    assert [k.tag for k in presets.PLATFORMS_LAST].index("Android") > [
        k.tag for k in presets.PLATFORMS_LAST
    ].index("SwiftUI")


FOUND = [
    ("We require strong SQL skills.", "SQL"),
    ("UI built with Tailwind for styling.", "Tailwind"),
    ("Uses Tailwind CSS design system.", "Tailwind"),
    ("Native iOS views in SwiftUI.", "SwiftUI"),
    ("REST API built with NestJS.", "NestJS"),
    ("GitOps pipeline managed by ArgoCD.", "ArgoCD"),
    ("GitOps pipeline managed by Argo CD.", "ArgoCD"),
    ("Embeddings stored in Pinecone.", "Vector DB"),
    ("Chroma for local retrieval.", "Vector DB"),
    ("Chromatic colours", "Vector DB"),
    ("Uses a vector store for retrieval.", "Vector DB"),
    ("Our stack is Golang and more.", "Go"),
    ("We build microservices in Go and more.", "Go"),
    ("Backend built with Spring framework.", "Spring Boot"),
    ("Expert C++ and low-level programming", "C++"),
    ("Experience with C# and .NET", ".NET"),
    ("Experience with C# and .NET", "C#"),
    ("Built with ASP.NET MVC", ".NET"),
    ("Frontend in Vue.js and Next.js", "Next.js"),
    ("PYTHON everywhere", "Python"),
    ("Weights &amp; Biases runs", "Weights & Biases"),
    ("Ruby on Rails", "Rails"),
    ("INGÉNIERIE de prompts", "Prompt Engineering"),
    ("aPſ. poſtgres", "PostgreSQL"),
    ("finetuning of models", "Fine-tuning"),
    ("agents IA", "AI Agents"),
]
NOT_FOUND = [
    ("JavaScript developer", "Java"),
    ("We trust our teams", "Rust"),
    ("Entrevue avec le responsable", "Vue"),
    ("Google, Meta, Agora, undergo", "Go"),
    ("go-to-market", "Go"),
    ("MySQL and PostgreSQL 15", "SQL"),
    ("scalability", "Scala"),
    ("&lt;span data-is-last-node=&quot;&quot;&gt;Meta&lt;/span&gt;", "Node.js"),
    ('<p data-path-to-node="0">Java</p>', "Node.js"),
    ("du café très vite", "Vite"),
    ("élanR et Ré", "R"),
    ("please rest here", "REST"),
]


def test_keywords_found(spark):
    for (text, tag), tags in zip(FOUND, tags_of(spark, [t for t, _ in FOUND]), strict=True):
        assert tag in tags, text


def test_keywords_not_found(spark):
    pairs = zip(NOT_FOUND, tags_of(spark, [t for t, _ in NOT_FOUND]), strict=True)
    for (text, tag), tags in pairs:
        assert tag not in tags, text


def test_tags_keep_dictionary_order_and_repeats(spark):
    [tags] = tags_of(spark, ["natural language processing (NLP), then Python"])
    assert tags == ["Python", "NLP", "NLP"]


def test_lead_words_never_hide_a_match(spark):
    """Random mixes of fragments: same tags as the plain regular expressions give."""
    pick = random.Random(7)
    fragments = [e.tag for e in presets.KEYWORDS] + [
        "go", "R2", "_R", "C++11", "apache", "Apache  Spark", "vector  DB", "fine tuning", "é",
        "IA générative", "Kafkaé", "Ci/cd", "AI  Agent", "ing", "ingénierie prompts", ".", "/",
        "İOS", "Node.jsx", "postgresqlx", "Hugging Face", "huggingface", "weights and biases",
    ]
    texts = []
    for _ in range(400):
        words = [pick.choice(fragments) for _ in range(pick.randint(1, 6))]
        words = [w.upper() if pick.random() < 0.2 else w for w in words]
        texts.append(pick.choice(["", " ", "x", "-"]).join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    tagged = with_keyword_tags(frame, ["t"], presets.KEYWORDS, "tags", markup=False)
    plain = F.array_compact(
        F.array(
            *[
                F.when(
                    patterns.matches(F.col("t"), e.anchored, not e.case_sensitive), F.lit(e.tag)
                )
                for e in presets.KEYWORDS
            ]
        )
    )
    assert tagged.where(F.col("tags") != plain).count() == 0
    # and the Java reading is the Unicode-aware one
    mine = [r.tags for r in tagged.orderBy("i").collect()]
    for text, tags in zip(texts, mine, strict=True):
        flags = [0 if e.case_sensitive else re.IGNORECASE for e in presets.KEYWORDS]
        expected = [
            e.tag
            for e, flag in zip(presets.KEYWORDS, flags, strict=True)
            if re.search(e.anchored, text, flag)
        ]
        assert tags == expected, text


def test_first_match_null_value_ends_the_search(spark):
    rules = [Rule("x", "(?i)hybrid", None), Rule("x", "(?i)remote", True), Rule("y", "z", False)]
    got = values(
        spark,
        first_match(rules, None, "boolean"),
        [("Hybrid remote", "z"), ("REMOTE", None), (None, "z"), ("office", None)],
        "x string, y string",
    )
    assert got == [None, True, False, None]


def test_first_match_default(spark):
    got = values(spark, first_match([Rule("x", "a", "A")], "none"), ["b", "a", None], "x string")
    assert got == ["none", "A", "none"]


SENIORITY = [
    ("Software Engineer Intern", "internship"),
    ("Développeur débutant", "junior"),
    ("Staff Engineer", "staff"),
    ("Principal Engineer", "principal"),
    ("Technical  Lead", "lead"),
    ("Lead Dev", "lead"),
    ("Sr. Developer", "senior"),
    ("DÉVELOPPEUR EXPÉRIMENTÉ", "senior"),
    ("Directeur TI", "director"),
    ("Gestionnaire TI", "manager"),
    ("Software Engineer", None),
    ("Internal tools", None),
]


def test_seniority(spark):
    rule = first_match(presets.SENIORITY_RULES)
    got = values(spark, rule, [t for t, _ in SENIORITY], "title string")
    assert got == [want for _, want in SENIORITY]
    wide = first_match(presets.WIDE_SENIORITY_RULES)
    assert values(spark, wide, ["Responsable TI"], "title string") == ["manager"]
    assert values(spark, rule, ["Responsable TI"], "title string") == [None]


GATED = """Paralegal|Senior Paralegal|Legal Counsel|Conseillère juridique|Avocate corporative|Notaire
Recruteur|Talent Acquisition Specialist|Human Resources Manager|HR Business Partner|Marketing Manager
Coordonnateur Marketing|Gestionnaire des Médias de Performance|Gestionnaire de Médias Sociaux
Responsable Médias|Spécialiste Publicité|Directrice Médias|Acheteur Médias|Planificatrice Médias
Media Strategist|Sales Account Executive|Représentant des ventes|Finance Analyst|Comptable|Bookkeeper
Administrative Assistant|Réceptionniste|Nursing Teaching Assistant|Infirmière|Professeure
Chargé de cours|Bibliothécaire|Civil Engineer|Ingénieure civile|Ingénieur en structure|Wealth Advisor
Portfolio Manager|Conseillère en gestion de patrimoine|Actuary|Underwriter|Claims Adjuster|Teller
Gestionnaire en Marketing|Agent Méthodes-FTC (tests mécaniques)|Concepteur cabine|Cabin Designer
Agent(e) Méthodes-FTC (tests)/Methods Specialist|Agent(e) de Méthodes - Support|Concepteur.trice Cabine
Préposé, entrepôt II|Préposée au service|Warehouse Attendant|Client Financial Services Agent
Senior Advisor, Personal|Advisor, Corporate Accounting|Senior Manager, Internal Audit|PARALEGAL
Assistant d'enseignement""".replace("\n", "|").split("|")
PASSING = """Senior Backend Engineer|Data Analyst|Développeur Full Stack|Ingénieur logiciel
Gestionnaire d'infrastructure|Engineering Manager|Product Manager|Product Designer|CTO
Backend Engineer, Financial Reporting Platform|Software Engineer, Structural Health Monitoring
""".strip().replace("\n", "|").split("|")


def test_title_gate(spark):
    gate = is_non_tech_title(F.col("t"))
    got = dict(zip(GATED, values(spark, gate, GATED, "t string"), strict=True))
    assert [t for t, hit in got.items() if not hit] == []
    assert not any(values(spark, gate, [*PASSING, "", None], "t string"))


SEGMENT_CASES = [
    (["SwiftUI", "iOS"], "mobile"),
    (["iOS", "Swift"], "mobile"),
    (["iOS", "Kotlin"], None),
    (["Android", "Kotlin"], "mobile"),
    (["Java", "Kafka"], "fintech"),
    (["Java", "Kafka", "AWS", "SQL", "Docker"], "fintech"),
    (["LangChain", "OpenAI"], "ai_ml"),
    (["LangChain"], None),
    (["Python", "PyTorch", "AWS", "Kubernetes"], "ai_ml"),
    (["Docker", "AWS"], "cloud_platform"),
    (["Docker"], None),
    ([".NET", "Angular"], "consulting"),
    (["C#", "Angular", "Docker", "Helm"], "cloud_platform"),
    (["Spring Boot", "Azure", "MySQL"], "enterprise"),
    (["Java", "Azure"], None),
    (["React", "Django"], "startup_saas"),
    (["React", "COBOL"], None),
    ([], None),
    (None, None),
]


def test_segments(spark):
    rows = [(tags,) for tags, _ in SEGMENT_CASES]
    got = values(spark, segment(F.col("s"), presets.SEGMENTS), rows, "s array<string>")
    assert got == [want for _, want in SEGMENT_CASES]


def test_evidence_first_field_and_snippet(spark):
    long = "x" * 60 + " uses python daily and also Python " + "y" * 60
    frame = spark.createDataFrame(
        [(1, "Go developer 😀 Go", long), (2, "Spring", "Boot")], "id int, title string, body string"
    )
    found = keyword_evidence(frame, ["id"], ["title", "body"], presets.KEYWORDS).collect()
    by_tag = {(r.id, r.tag): r for r in found}
    go = by_tag[1, "Go"]
    assert (go.field, go.snippet) == ("title", "...Go developer 😀 Go...")
    assert go.effective_pattern == r"\b(?:Go|Golang)\b"
    python = by_tag[1, "Python"]
    assert python.field == "body"
    start = long.index("python")
    assert python.snippet == "..." + long[start - 40 : start + 6 + 40].strip() + "..."
    assert by_tag[2, "Spring Boot"].field == "title"


def test_evidence_none_when_a_hit_spans_fields(spark):
    frame = spark.createDataFrame([(1, "GitHub", "Actions")], "id int, a string, b string")
    entry = [Keyword("GitHub Actions", "GitHub Actions")]
    assert with_keyword_tags(frame, ["a", "b"], entry, "t").first().t == ["GitHub Actions"]
    assert keyword_evidence(frame, ["id"], ["a", "b"], entry).count() == 0


def test_only_words_that_begin_with_a_lead_word_are_found(spark):
    """Words such as "testing" hold a lead word but no entry can match there."""
    entries = [k for k in presets.KEYWORDS if k.tag in ("Prompt Engineering", "REST", "Go")]
    finder = rules._Finder(entries)
    texts = ["testing, restless forests", "ingénierie de prompts", "éging GO_go", "go", "RESTful; go-rest", "mango gov", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select(F.lower("text").alias("text")).select("text", finder.found(F.col("text")).alias("found"))
    got = [(r.found, r.tried) for r in found.select("found", finder.entries("found").alias("tried")).collect()]
    assert got == [(["restless"], [1]), (["ing"], [2]), (["go"], [0]), (["go"], [0]),
                   (["restful", "go", "rest"], [0, 1]), ([], []), ([], [])]
