"""Scalar text functions as column expressions.

Word characters are Unicode letters, digits and the underscore throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
NAME_SUFFIXES = ["System", "Module", "Service", "Application", "Process", "Workflow", "Rule", "Field"]
QUESTION_WORDS = ["What", "How", "Why", "When", "Where", "Which", "Who", "Does", "Is", "Are"]
PATTERN_KEYWORDS = {
    "dependency": ["depend", "depends", "dependency", "dependencies", "require", "requires", "prerequisite", "needed", "impact", "affect", "affects"],
    "integration": ["integrate", "integrates", "integration", "connect", "connects", "connection", "interface", "communicate", "communicates"],
    "workflow": ["workflow", "process", "flow", "step", "steps", "procedure", "sequence"],
    "conflict": ["conflict", "conflicts", "contradiction", "contradicts", "inconsistent", "inconsistency", "disagree", "disagrees"],
    "comparison": ["compare", "comparison", "difference", "differences", "similar", "similarity", "versus", "vs", "between"],
    "rule": ["rule", "rules", "policy", "policies", "regulation", "regulations", "risk", "compliance", "applies", "applicable"],
}
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
NER_TYPES = {"ORG": "System", "PRODUCT": "System", "GPE": "System", "MONEY": "Field", "DATE": "Field", "PERSON": "Field"}


def sentences(text: Column) -> Column:
    """Sentences after ``.``, ``!`` or ``?`` and white space; trimmed, none empty."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def token_count(text: Column) -> Column:
    """Four characters a token; null counts as empty."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def breadcrumbs(title: Column, heading: Column) -> Column:
    return F.concat_ws(" > ", title, F.when(F.trim(heading) != "", heading))


def is_acronym(token: Column) -> Column:
    """Two or more characters, some letter, no letter that isn't upper case."""
    bare = F.regexp_replace(token, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return (F.length(bare) >= 2) & bare.rlike(r"\p{L}") & ~bare.rlike(r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]")


def bm25_tokens(text: Column) -> Column:
    """Index terms: acronyms keep their case less edge punctuation, other tokens
    are lower-cased and lose all punctuation; none empty."""
    one = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    bare = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    # blanks stay, so both splits have the same places; the patterns run only on tokens without lower case
    plain = F.split(F.regexp_replace(F.lower(one), r"[^\p{L}\p{N}_ ]+", ""), " ")
    each = F.zip_with(F.split(one, " "), plain, lambda t, p: F.when(~t.rlike("[a-z]") & is_acronym(t), bare(t)).otherwise(p))
    return F.filter(each, lambda t: t != "")


def normalise_name(name: Column) -> Column:
    """Canonical form of an entity's name."""
    one = F.regexp_replace(F.trim(name), r"\s+", " ")
    first = F.substring_index(one, " ", 1)
    upper = lambda x: (x == F.upper(x)) & x.rlike(r"\p{L}")
    base = F.regexp_replace(one, rf" ({'|'.join(NAME_SUFFIXES)})$", "")
    short = (F.length(one) <= 6) & upper(one)
    return F.when(short, one).when((F.length(first) <= 6) & upper(first), first).when(F.contains(base, F.lit(" ")), F.initcap(base)).otherwise(base)


def entity_id(canonical: Column, chunk: Column) -> Column:
    """A deterministic id from name and chunk."""
    return F.concat(F.lit("ent_"), F.substring(F.sha2(F.lower(canonical), 256), 1, 8), F.lit("_"), chunk)


def mentions(question: Column) -> Column:
    """Quoted strings, then acronyms, then capitalised runs, each once."""
    quoted = F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1))
    acronyms = F.regexp_extract_all(question, F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{2,6}(?![\p{L}\p{N}_])"), F.lit(0))
    runs = F.regexp_extract_all(question, F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![\p{L}\p{N}_])"), F.lit(0))
    named = F.filter(runs, lambda x: ~x.isin(QUESTION_WORDS))
    every = F.concat(quoted, acronyms, named)
    both = F.struct(every.alias("all"), F.transform(every, F.lower).alias("low"))
    # bound once, not computed anew for each element
    return F.get(F.transform(F.array(both), lambda b: F.filter(b["all"], lambda x, i: F.array_position(b["low"], F.lower(x)) == i + 1)), 0)


def query_pattern(question: Column) -> Column:
    """The first kind of graph question one of whose keywords occurs."""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = None
    for kind, keys in PATTERN_KEYWORDS.items():
        hit = low.rlike("|".join(keys))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("general")


def query_mode(question: Column) -> Column:
    """Offline route: graph questions go to the graph, those that name nothing to
    vectors, the rest to both."""
    kind = query_pattern(question)
    return F.when(kind.isin("dependency", "integration", "workflow", "conflict"), "GRAPH").when((kind == "general") & (F.size(mentions(question)) == 0), "VECTOR").otherwise("HYBRID")


def routed_mode(reply: Column, least: float = 0.7) -> Column:
    """Mode of a model's JSON reply; hybrid where it is missing, invalid or unsure."""
    parsed = F.from_json(fenced_json(reply), "mode string, confidence double")
    mode = F.upper(parsed["mode"])
    return F.when(mode.isin("VECTOR", "GRAPH", "HYBRID") & (parsed["confidence"] >= least), mode).otherwise("HYBRID")


def fenced_json(reply: Column) -> Column:
    """The outermost JSON object of a reply, fences or not; null without one."""
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_array(reply: Column, element: str = "string") -> Column:
    """The outermost JSON array of a reply as an array; empty on failure."""
    found = F.regexp_extract(reply, r"(?s)\[.*\]", 0)
    return F.coalesce(F.from_json(found, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def string_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))


def initials(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.left(x, F.lit(1))), "")


def acronym_of(short: Column, full: Column) -> Column:
    return (F.length(short) >= 3) & F.startswith(initials(full), short)


def entity_similarity(canon_a: Column, canon_b: Column, name_a: Column, name_b: Column) -> Column:
    a, b = F.lower(canon_a), F.lower(canon_b)
    held = F.when(F.contains(a, b) | F.contains(b, a), 0.3).otherwise(0.0)
    short = F.when(acronym_of(a, b) | acronym_of(b, a), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), 0.7 * string_similarity(a, b) + 0.3 * string_similarity(F.lower(name_a), F.lower(name_b)) + held + short)


def citations(answer: Column) -> Column:
    """Bracketed references with exactly one colon, each once, in order."""
    found = F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.size(F.split(x, ":")) == 2))


def claims(answer: Column) -> Column:
    """Sentences over ten characters, without their references."""
    bare = F.regexp_replace(answer, r"\[[^\]]+\]", "")
    return F.filter(F.transform(F.split(bare, r"[.!?]+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 10)


def masked_connection(text: Column) -> Column:
    """A connection string with its password starred."""
    return F.regexp_replace(text, r"(://[^:/@]+:)[^@]+@", "$1****@")


def ner_type(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in NER_TYPES.items() for x in pair])
    return F.coalesce(F.get(F.array(table), F.lit(0))[label], F.lit("System"))


def joined_sentences(text: Column) -> Column:
    """Sentences with a mark between them, to be searched by ``entity_context``."""
    return F.array_join(sentences(F.replace(text, F.lit("\x01"), F.lit(" "))), "\x01")


def entity_context(text: Column, value: Column, joined: Column | None = None) -> Column:
    """The first sentence that holds ``value``, else the text's first 200 characters.
    ``joined``: the text's sentences, joined once for all values; the search stops
    at the first hit."""
    joined = joined_sentences(text) if joined is None else joined
    at = F.instr(joined, value)
    left = F.substring_index(F.substring(joined, F.lit(1), at - 1), "\x01", -1)
    right = F.substring_index(F.substring(joined, at, F.length(joined)), "\x01", 1)
    return F.when(at > 0, F.concat(left, right)).otherwise(F.substring(text, 1, 200))


def chunk_uuid(chunk_id: Column) -> Column:
    """UUID version 5 of a chunk's id in the DNS name space."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(chunk_id, "UTF-8"))))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def batch_size(mean_chars: Column) -> Column:
    """Rows a batch of an embedding model from the mean text length."""
    return F.when(mean_chars / 4 < 100, 64).when(mean_chars / 4 < 300, 32).otherwise(16)
