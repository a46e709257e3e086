"""Text columns: normal forms, keys, tokens and lexical relevance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in a query.
STOP_WORDS = (
    "a an the and or of to in on at by for from with about as is are was were be been being do does did doing "
    "have has had having who what where when why how which whom whose his her hers him their theirs them my mine "
    "our ours your yours this that these those it its he she they we you i current currently now today latest "
    "former formerly previous previously before after ago please tell me show find get list any some all"
).split()


def normal(text: Column) -> Column:
    """Trimmed, white space collapsed to one space, lower case with ß as ss."""
    return F.replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def is_class_key(key: Column) -> Column:
    return key.rlike("^[A-Z][A-Za-z0-9]*$")


def is_predicate_key(key: Column) -> Column:
    return key.rlike("^[a-z][A-Za-z0-9]*$")


def _raised(part: Column) -> Column:
    return F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 30))


def _parts(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), "[^A-Za-z0-9]+"), lambda x: x != "")


def suggest_class_key(text: Column) -> Column:
    """PascalCase key from free text; text without letters and digits stays."""
    key = F.array_join(F.transform(_parts(text), _raised), "")
    return F.when(key == "", text).otherwise(key)


def suggest_predicate_key(text: Column) -> Column:
    """lowerCamelCase key from free text; text without letters and digits stays."""
    key = suggest_class_key(text)
    lowered = F.concat(F.lower(F.substring(key, 1, 1)), F.substring(key, 2, 1 << 30))
    return F.when(F.size(_parts(text)) == 0, text).otherwise(lowered)


def source_system_key(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]+", "_"), F.lit("_"))


def words(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))


def phrase(query: Column) -> Column:
    return F.array_join(words(query), " ")


def content_tokens(query: Column) -> Column:
    """Distinct words of two characters and more that are no stop words, in order."""
    return F.array_distinct(F.filter(words(query), lambda x: (F.length(x) >= 2) & ~x.isin(STOP_WORDS)))


def lexical(query: Column, tokens: Column, said: Column, fields: Column) -> Column:
    """Struct (score, reason) of a query against an array of text fields.

    ``tokens`` and ``said`` are the query's content tokens and phrase. The first rule that holds
    gives the score.
    """
    def is_(score: Column | float, reason: str) -> Column:
        return F.struct((F.lit(score) if isinstance(score, float) else score).alias("score"), F.lit(reason).alias("reason"))

    def rule(x: Column) -> Column:
        clean, blob, q, hits, n = (x[c] for c in ("clean", "blob", "q", "hits", "n"))
        share, whole = hits / n, x["whole"]
        return (
            F.when((q == "") | q.isNull() | (F.size(clean) == 0), is_(0.0, ""))
            .when(F.array_contains(clean, q) | ((said != "") & F.array_contains(clean, said)), is_(1.0, "exact_text"))
            .when(whole & (n == 1), is_(1.0, "exact_token_name"))
            .when(whole & ((n == 2) | (hits >= F.greatest(F.lit(2), F.floor((n + 1) / 2)))), is_(0.95, "exact_token_name"))
            .when(whole, is_(0.40 + 0.25 * share, "exact_token_name_sparse"))
            .when((said != "") & F.contains(blob, said), is_(0.85, "phrase_contains"))
            .when(F.contains(blob, q), is_(0.80, "query_contains"))
            .when(n == 0, is_(0.25, "weak_normalized_match"))
            .when(hits == 0, is_(0.15, "candidate_without_token_overlap"))
            .when(hits == n, is_(0.75, "all_tokens_present"))
            .when(hits >= 2, is_(0.45 + 0.25 * share, "multi_token_partial"))
            .otherwise(is_(0.38, "partial_token_match"))
        )

    def counted(x: Column) -> Column:
        hits = F.size(F.filter(tokens, lambda t: F.contains(x["blob"], t)))
        whole = F.size(F.array_intersect(x["clean"], tokens)) > 0
        return F.struct(x["clean"].alias("clean"), x["blob"].alias("blob"), F.trim(F.lower(query)).alias("q"), hits.alias("hits"), F.size(tokens).alias("n"), whole.alias("whole"))

    clean = F.filter(F.transform(fields, lambda x: F.trim(F.lower(x))), lambda x: x.isNotNull() & (x != ""))
    # What the rules share is worked out once for a row.
    joined = _held(clean, lambda x: F.struct(x.alias("clean"), F.array_join(x, " ").alias("blob")))
    return _held(_held(joined, counted), rule)


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def canonical_body(content: Column) -> Column:
    """Lines ended by LF without blanks at their ends, no blank lines at the end, one final LF."""
    lf = F.regexp_replace(content, "\r\n?", "\n")
    bare = F.rtrim(F.regexp_replace(lf, "(?m)[ \t]+$", ""), F.lit("\n"))
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))
