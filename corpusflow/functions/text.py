"""Text expressions: tokens, cleaning, query understanding, routing and quality, all as columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Word lists of query understanding.
QUESTION_WORDS = "what why how when where who which whose whom is are was were do does did can could should would".split()
COMMAND_VERBS = "find show list get give fetch search compare summarize explain describe tell".split()
STOPWORDS = "the a an of to in on for and or is are my your it this that with at by be as".split()
# Word lists of the complexity estimate.
COMPLEXITY_STOP = "the a an is are was were what how who in on of to for and or it this that do does did can with from at by be has have had will would could should may might".split()
COMPLEXITY_SIGNALS = {
    "temporal": "trend over years history since before after when year month quarter annual monthly weekly period timeline progression growth change shift".split(),
    "comparative": "compare vs versus difference between than better worse higher lower more less which contrast relative against".split(),
    "causal": "why because reason cause explain impact effect result due lead affect influence drove driven factor contribute".split(),
    "multi_concept": "list all every summarize overview breakdown detail describe outline enumerate".split(),
}
# Patterns of query classes and their weights.
CLASS_SIGNALS = {
    "technical": (3, r"\b(def |class |import |return |function|error|exception|bug|fix|null|api|sdk|cli|regex|json|xml|sql|http|url|uri|v\d+\.\d+|[a-z_]+\(\)|[A-Z][A-Z_]{2,}|[a-z]+_[a-z_]+)\b"),
    "conceptual": (2, r"(?i)\b(concept|theory|meaning|philosophy|principle|framework|paradigm|architecture|strategy|approach|overview|introduction|fundamentals|explain|describe|understand|insight|perspective|impact|effect)\b"),
    "analytical": (2, r"(?i)\b(compare|contrast|analyse|analyze|trend|difference|versus|vs\.?|better|worse|tradeoff|pros|cons|advantages|disadvantages|evaluate|assess|rank|benchmark)\b"),
    "factual": (1, r"(?i)\b(who|what|when|where|which|how many|how much|did|does|is|are|was|were|name|list|show|tell|give)\b"),
}
# Weights of dense and sparse search by profile, and the profile of each query class.
PROFILES = {"balanced": (0.6, 0.4), "semantic": (0.8, 0.2), "keyword": (0.3, 0.7), "technical": (0.3, 0.7), "conceptual": (0.8, 0.2), "equal": (0.5, 0.5)}
CLASS_PROFILE = {"technical": "technical", "conceptual": "conceptual", "analytical": "semantic", "factual": "balanced", "general": "balanced"}
# Topics and the phrases that tell them.
TOPICS = {
    "Finance": ["revenue", "profit", "loss", "income", "earnings", "budget", "financial", "fiscal", "accounting", "balance sheet", "cash flow"],
    "Sales": ["sales", "deal", "pipeline", "quota", "crm", "customer", "leads", "conversion", "closed won"],
    "HR": ["employee", "headcount", "hiring", "onboarding", "payroll", "benefits", "performance review", "retention"],
    "Technology": ["api", "software", "code", "deploy", "infrastructure", "cloud", "database", "architecture", "engineering"],
    "Marketing": ["campaign", "brand", "advertising", "seo", "content", "social media", "conversion rate", "funnel"],
    "Legal": ["contract", "compliance", "regulation", "gdpr", "policy", "terms", "liability", "agreement", "intellectual property"],
    "Operations": ["supply chain", "logistics", "manufacturing", "inventory", "process", "efficiency", "workflow", "capacity"],
}
SENTENCE_GAP = r"(?<=[.!?])\s+"


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case; null gives null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space at the ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Pieces after which a full stop, question or exclamation mark and white space stand; blank ones are left out."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: F.trim(s) != "")


def clean_space(text: Column) -> Column:
    """Line ends as line feeds, runs of blanks as one, no blanks at line ends, at most one blank line, trimmed."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern, by in ((r"[ \t]{2,}", " "), (r"[ \t]+(\n|$)", "$1"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, by)
    return out


@F.pandas_udf(StringType())
def compose(text: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC), which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def clean_text(text: Column) -> Column:
    """``clean_space`` of the composed form; only texts beyond ASCII pass through Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return clean_space(F.when(plain, text).otherwise(compose(text)))


def derive_title(text: Column) -> Column:
    """The first line that isn't blank, without leading hash signs, cut at 200 characters; null if there is none."""
    first = F.try_element_at(F.filter(F.transform(F.split(text, r"\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", "")), lambda l: l != ""), F.lit(1))
    return F.substring(F.trim(F.regexp_replace(first, "^#+", "")), 1, 200)


def normalize_query(query: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(query, r"\s+", " "))


def detect_intent(query: Column) -> Column:
    """empty, question, command or keyword."""
    text = F.lower(normalize_query(query))
    first = F.split_part(text, F.lit(" "), F.lit(1))
    return F.when(text == "", "empty").when(text.endswith("?") | first.isin(QUESTION_WORDS), "question").when(first.isin(COMMAND_VERBS), "command").otherwise("keyword")


def query_entities(query: Column) -> Column:
    """Capitalised words, numbers (those of dates too) and ISO dates."""
    found = lambda p: F.regexp_extract_all(query, F.lit(p), F.lit(0))
    return F.struct(found(r"\b[A-Z][a-zA-Z0-9]+\b").alias("capitalized"), found(r"\b\d+(?:\.\d+)?\b").alias("numbers"), found(r"\b\d{4}-\d{2}-\d{2}\b").alias("dates"))


def keywords(query: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(query), lambda t: ~t.isin(STOPWORDS))


def expand(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """The synonyms of each term, in order."""
    if not synonyms:
        return F.array().cast("array<string>")
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), strings(v))])
    return F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))


def process_query(query: Column, synonyms: dict[str, list[str]]) -> Column:
    """normalized, intent, entities, keywords, expansion and expanded_query."""
    normalized = normalize_query(query)
    kept = keywords(normalized)
    added = expand(kept, synonyms)
    both = F.concat(kept, added)
    return F.struct(normalized.alias("normalized"), detect_intent(query).alias("intent"), query_entities(query).alias("entities"), kept.alias("keywords"), added.alias("expansion"), F.when(F.size(both) > 0, F.array_join(both, " ")).otherwise(normalized).alias("expanded_query"))


def classify_query(query: Column) -> Column:
    """technical, conceptual, analytical, factual (ties in this order) or general."""
    scores = {k: F.size(F.regexp_extract_all(query, F.lit(p), F.lit(0))) * w for k, (w, p) in CLASS_SIGNALS.items()}
    most = F.greatest(*scores.values())
    return reduce(lambda c, k: c.when(scores[k] == most, k), scores, F.when(most == 0, "general"))


def profile_of_class(query_class: Column) -> Column:
    """The weight profile of a query class."""
    return reduce(lambda c, x: c.when(query_class == x[0], x[1]), CLASS_PROFILE.items(), F.when(F.lit(False), "")).otherwise("balanced")


def profile_weights(profile: Column) -> Column:
    """dense and sparse weight of a profile; unknown ones are balanced."""
    pair = lambda w: F.struct(F.lit(w[0]).alias("dense"), F.lit(w[1]).alias("sparse"))
    return reduce(lambda c, x: c.when(profile == x[0], pair(x[1])), PROFILES.items(), F.when(F.lit(False), pair((0.0, 0.0)))).otherwise(pair(PROFILES["balanced"]))


def normalize_weights(dense: Column, sparse: Column) -> Column:
    """Both scaled to add up to one; two zeros are a half each."""
    total = dense + sparse
    return F.struct(F.when(total == 0, 0.5).otherwise(F.try_divide(dense, total)).alias("dense"), F.when(total == 0, 0.5).otherwise(F.try_divide(sparse, total)).alias("sparse"))


def complexity(query: Column) -> Column:
    """level, score, signals, recommended_chunks and recommended_tokens."""
    every = F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    known = F.filter(F.transform(every, lambda w: F.lower(w)), lambda w: ~w.isin(COMPLEXITY_STOP))
    fired = {k: F.arrays_overlap(known, strings(v)) for k, v in COMPLEXITY_SIGNALS.items()}
    fired["multi_concept"] = fired["multi_concept"] | (F.size(every) > 12)
    signals = F.array_compact(F.array(*[F.when(c, k) for k, c in fired.items()]))
    score = F.size(signals)
    pick = lambda a, b, c: F.when(score == 0, a).when(score == 1, b).otherwise(c)
    return F.struct(pick("simple", "moderate", "complex").alias("level"), score.alias("score"), signals.alias("signals"), pick(2, 5, 10).alias("recommended_chunks"), pick(500, 1500, 3000).alias("recommended_tokens"))


def decompose(question: Column, most: int = 5) -> Column:
    """Sub-questions: one a year of a comparison, else one a question mark, else one an "and", else the question."""
    q = strip(question)
    years = F.regexp_extract_all(q, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))
    compared = F.size(years).__ge__(2) & q.rlike(r"(?i)\b(compar|differ|change|changed|vs\.?|versus|between|from .+ to )\b")
    base = F.lower(F.regexp_replace(F.regexp_replace(q, r"\b(?:19|20)\d{2}\b", ""), r"^[ ,?]+|[ ,?]+$", ""))
    base = F.trim(F.regexp_replace(base, r"^(how did|what was|how much did)\s+", ""))
    by_year = F.concat(F.transform(F.slice(years, 1, most - 1), lambda y: F.concat(F.lit("What was "), base, F.lit(" in "), y, F.lit("?"))), F.array(F.concat(F.lit("What is the difference between "), F.try_element_at(years, F.lit(1)), F.lit(" and "), F.try_element_at(years, F.lit(2)), F.lit("?"))))
    cut = lambda pattern: F.filter(F.transform(F.split(q, pattern), lambda p: strip(p)), lambda p: p != "")
    by_mark, by_and = cut(r"\?"), cut(r"(?i)\s+and\s+")
    alone = F.array(F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?"))))
    ended = F.transform(F.slice(by_and, 1, most), lambda p: F.concat(F.regexp_replace(p, r"\?+$", ""), F.lit("?")))
    return F.when(compared, F.slice(by_year, 1, most)).when(F.size(by_mark) > 1, F.transform(F.slice(by_mark, 1, most), lambda p: F.concat(p, F.lit("?")))).when(F.size(by_and) > 1, ended).otherwise(alone)


def topics(text: Column) -> Column:
    """The topics of which a phrase occurs in the text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(reduce(Column.__or__, (low.contains(p) for p in phrases)), topic) for topic, phrases in TOPICS.items()]))


def highlight(text: Column, query: Column, most: int = 300) -> Column:
    """The sentence that shares most different query keywords, the first on ties, cut; the text's start without any."""
    wanted = F.array_distinct(keywords(query))
    shared = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(tokens(s), wanted)).alias("n"), (-i).alias("i"), s.alias("s")))
    best = F.array_max(shared)
    return F.substring(F.coalesce(F.when(best["n"] > 0, best["s"]), text), 1, most)


def noise_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor ordinary marks; 1 for the empty text."""
    odd = F.regexp_replace(text, r"""[\p{L}\p{Nd} \n\t.,;:!?\-'"()\[\]{}/@#%&*+=_<>|\\~`^]""", "")
    return F.when(F.length(text) == 0, 1.0).otherwise(F.try_divide(F.length(odd), F.length(text)))


def assess_quality(text: Column, language: Column, quality_flag: Column | None = None) -> Column:
    """score, action, readable, word_count, noise_ratio, avg_word_length and flags of a text whose language is given.

    A null text is judged as the empty one; a null language costs a tenth from five words on.
    """
    text = F.coalesce(text, F.lit(""))
    every = words(text)
    n, noise = F.size(every), noise_ratio(text)
    mean = F.coalesce(F.try_divide(F.length(F.array_join(every, "")), n), F.lit(0.0))
    flag = F.lit(None).cast("string") if quality_flag is None else quality_flag
    rules = [
        ("too_short", n < 5, 0.5), ("very_short", n.between(5, 19), 0.2), ("ocr_noise", noise > 0.4, 0.4), ("possible_ocr_noise", (noise > 0.2) & (noise <= 0.4), 0.15),
        ("unusual_word_length_low", (mean < 2) & (n > 5), 0.15), ("unusual_word_length_high", (mean > 15) & (n > 5), 0.1),
    ]
    unknown = language.isNull() & (n >= 5)
    flags = F.array_compact(F.array(*[F.when(c, k) for k, c, _ in rules], flag, F.when(unknown, "unknown_language")))
    stub = F.when(flag.isin("ocr_unavailable", "transcription_unavailable"), 0.2).otherwise(0.0)
    lost = reduce(Column.__add__, [F.when(c, p).otherwise(0.0) for _, c, p in rules], stub) + F.when(unknown, 0.1).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), 1 - lost), 3)
    action = F.when(score >= 0.7, "ok").when(score >= 0.3, "warn").otherwise("reject")
    return F.struct(score.alias("score"), action.alias("action"), (score >= 0.5).alias("readable"), n.alias("word_count"), F.round(noise, 3).alias("noise_ratio"), F.round(mean, 2).alias("avg_word_length"), flags.alias("flags"))


def similarity_band(score: Column) -> Column:
    """How alike two texts of a cosine are."""
    return F.when(score >= 0.85, "very similar").when(score >= 0.65, "similar").when(score >= 0.45, "moderate").when(score >= 0.2, "dissimilar").otherwise("very different")


def citation_markers(text: Column) -> Column:
    """Different markers such as [1], in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\d+\]"), F.lit(0)))


@F.pandas_udf(StringType())
def without_accents(text: pd.Series) -> pd.Series:
    """Unicode's decomposed form (NFKD) without what isn't ASCII then."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")


def slug(name: Column) -> Column:
    """Lower-cased without accents, with everything but letters and digits as single underscores, none at the ends.

    Only names beyond ASCII pass through Python.
    """
    plain = F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(without_accents(name))
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), "^_+|_+$", "")
