"""Personal data by patterns, terms that give it away by their co-occurrence in the corpus, and
texts without either.

DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.llm.common import checkpoint, text_of

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kinds in the order of reports, with patterns that find the contracts' leftmost matches in one
#: pass of linear time: a run is entered at its start (or where the last match ended) and never
#: given back; a card is a whole run of 13 to 19 digits with single separators.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TERM = "term"
KINDS = [*PATTERNS, TERM]
#: Letters of a term at least; distinct texts, and distinct neighbours of the term in them, that must
#: show it with an entity; share of the entity's information content, and bits of it, that a term
#: may give away at most.
LETTERS, SUPPORT, DISCLOSED, BITS = 3, 3, 0.95, 5.0
#: Terms, and their characters, or texts that may be broadcast (so some 20 MB at most); more are
#: joined by a shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 5_000_000
_NOT_LETTERS = r"[^\p{L}]+"


def _hits(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, gap, value): the characters before each match of the pattern, and the match
    (null for the last gap)."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    return F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["value"].alias("value")))


def _placed(hits: DataFrame) -> DataFrame:
    """Exploded hits with start and end, in code points."""
    key = ["doc_id", "h", "kind"]
    so_far = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length(F.coalesce("value", F.lit("")))
    hits = hits.dropDuplicates([*key, "k"]).withColumn("end", F.sum(F.col("gap") + length).over(so_far).cast("long"))
    return hits.withColumn("start", F.col("end") - length).filter("value IS NOT NULL")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(value)), ""), lambda x, k: F.coalesce(x.try_cast("int"), F.lit(0)) * (1 + k % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid() -> Column:
    value, kind = F.col("value"), F.col("kind")
    part_ok = lambda p: F.ltrim(p, F.lit("0")).try_cast("int").between(1, 255) | (F.ltrim(p, F.lit("0")) == "")
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), lambda p: F.coalesce(part_ok(p), F.lit(False))))
        .when(kind == "card", _luhn(value))
        .when(kind == "phone", F.length(_digits(value)).between(9, 15))
        .otherwise(True)
    )


def _entity() -> Column:
    """A value without what may differ between two ways to write it."""
    value, kind = F.col("value"), F.col("kind")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind == "ip", F.array_join(F.transform(F.split(value, r"\."), lambda p: p.try_cast("int").cast("string")), "."))
        .otherwise(_digits(value))
    )


def _words(text: Column) -> Column:
    """Runs of letters, lower-cased one by one."""
    return F.transform(F.filter(F.split(text, _NOT_LETTERS), lambda x: x != ""), lambda x: F.lower(x))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(_words(text)), lambda x: F.length(x) >= LETTERS)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def base_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row with kind null for each row of docs, and rows of all pattern matches' gaps and values.

    Null texts count as empty; repeated rows repeat all of it; other columns are not read.
    """
    text, rows = F.col("text"), _rows(docs, id_col, text_col)
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(PATTERNS["card"]), "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<struct<kind:string,gap:int,value:string>>")
    marker = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("value")))
    found = [F.when(may[k], _hits(text, p, k)).otherwise(empty) for k, p in PATTERNS.items()]
    return rows.select("doc_id", "h", F.posexplode(F.concat(marker, *found)).alias("k", "_")).select("doc_id", "h", "k", "_.*")


def _few(rows: DataFrame, text: str | None = None) -> DataFrame:
    """rows, marked for a broadcast if they are few and short."""
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0)) if text else F.lit(0)).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and chars <= BROADCAST_CHARS else rows


def _of(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of rows for each (doc_id, h) of keys."""
    keys = keys.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    return rows.join(_few(keys), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.h == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "h"])


def disclosing_terms(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Terms that reveal a protected entity: term, kind, disclosed. hits are rows of docs with what
    was found in them: doc_id, h, kind, value. Ways to write a value count as one entity.

    A term counts with an entity wherever one document has both. Of the entity's information
    content, -log2 P(entity), pointwise mutual information with the term is the part that the term
    gives away: log2 (P(entity, term) / (P(entity) P(term))), all of them shares of the documents
    (repeated rows count as often as they come). Terms are listed that give away DISCLOSED of it or
    more, and BITS at least, and that SUPPORT different texts show with the entity, with as many
    different neighbours (so that copies of one text are no support).
    """
    rows = _rows(docs, id_col, text_col)
    found = hits.select("doc_id", "h", "kind", _entity().alias("entity")).distinct()
    often = found.groupBy("kind", "entity").agg(F.countDistinct("h").alias("texts")).filter(F.col("texts") >= SUPPORT).select("kind", "entity")
    found = checkpoint(found.join(often, ["kind", "entity"]))
    if found.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, kind string, disclosed double")
    keys = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    copies = rows.select("doc_id", "h").join(_few(keys), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.h == F.col("_h")), "left_semi").groupBy("doc_id", "h").agg(F.count("*").alias("rows"))
    same = lambda x: found.doc_id.eqNullSafe(F.col(f"{x}_id")) & (found.h == F.col(f"{x}_h"))
    copies = copies.withColumnsRenamed({"doc_id": "c_id", "h": "c_h"})
    found = found.join(copies, same("c")).select("doc_id", "h", "kind", "entity", "rows")
    words = _of(rows, found).select("doc_id", "h", _words(F.col("text")).alias("words"))
    beside = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    terms = words.select(F.col("doc_id").alias("t_id"), F.col("h").alias("t_h"), F.explode(F.transform("words", lambda x, i: F.struct(x.alias("term"), F.xxhash64(beside(i - 1), beside(i + 1)).alias("beside")))).alias("_"))
    terms = terms.select("t_id", "t_h", "_.*").filter(F.length("term") >= LETTERS).groupBy("t_id", "t_h", "term").agg(F.min("beside").alias("beside"))
    pairs = found.join(terms, same("t")).groupBy("kind", "entity", "term").agg(F.sum("rows").alias("n_both"), F.countDistinct("h").alias("texts"), F.countDistinct("beside").alias("besides"))
    pairs = checkpoint(pairs.filter((F.col("texts") >= SUPPORT) & (F.col("besides") >= SUPPORT)))
    entities = found.groupBy("kind", "entity").agg(F.sum("rows").alias("n_entity"))
    candidates = pairs.select("term").distinct()
    # All words are counted before they meet the candidates, of which common words are many.
    seen = rows.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    n_term = seen.join(_few(candidates, "term"), "term")
    total = float(max(docs.count(), 1))
    both = pairs.join(entities, ["kind", "entity"]).join(n_term, "term")
    content = F.log2(F.lit(total) / F.col("n_entity"))
    information = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    both = both.withColumn("disclosed", F.when(content > 0, information / content)).filter((F.col("disclosed") >= DISCLOSED) & (information >= BITS))
    return both.groupBy("term").agg(F.max_by("kind", F.struct("disclosed", "kind")).alias("kind"), F.max("disclosed").alias("disclosed"))


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where the terms (column term) stand as whole runs of letters, in whatever case: doc_id, h,
    kind (TERM), start and end. Rows alike give one set of spans."""
    rows, terms = _rows(docs, id_col, text_col), _few(terms.select("term"), "term")
    having = rows.select("doc_id", "h", F.explode(_terms(F.col("text"))).alias("term")).join(terms, "term", "left_semi")
    having = checkpoint(having.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("term").alias("found")))
    texts = rows.join(_few(having), rows.doc_id.eqNullSafe(F.col("_id")) & (rows.h == F.col("_h"))).dropDuplicates(["doc_id", "h"])
    texts = texts.withColumn("runs", F.regexp_extract_all("text", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)))
    # Only runs that are terms are placed: each by the length of all before it.
    texts = texts.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("runs") - 1), lambda i: F.array_contains("found", F.lower(F.get("runs", i)))))
    start = lambda i: F.length(F.array_join(F.slice("runs", F.lit(1), i), "")).cast("long")
    spans = texts.select("doc_id", "h", F.explode(F.transform("at", lambda i: F.struct(start(i).alias("start"), F.length(F.get("runs", i)).alias("n")))).alias("_"))
    return spans.select("doc_id", "h", F.lit(TERM).alias("kind"), F.col("_.start").alias("start"), (F.col("_.start") + F.col("_.n")).alias("end"))


def _ordered(spans: DataFrame) -> DataFrame:
    """Per document: spans, an array of (kind number, start, end) in the order of reports."""
    number = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], 0))
    return spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct(number.alias("k"), "start", "end"))).alias("spans"))


def _name(k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), k + 1)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["k"]), x["start"], x["end"])), ",")


def _cleaned(rows: DataFrame) -> DataFrame:
    """Rows (text, found) with clean: the text with each span, or run of overlapping ones, as its
    first one's kind in brackets."""
    first = F.struct(F.array().cast("array<struct<a:int,b:int,k:int>>").alias("done"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("k"))
    flush = lambda s: F.when(s["a"] >= 0, F.array_append(s["done"], F.struct(s["a"].alias("a"), s["b"].alias("b"), s["k"].alias("k")))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        longer = F.struct(s["done"].alias("done"), s["a"].alias("a"), F.greatest(s["b"], x["b"]).alias("b"), s["k"].alias("k"))
        return F.when(x["a"] < s["b"], longer).otherwise(F.struct(flush(s).alias("done"), x["a"].alias("a"), x["b"].alias("b"), x["k"].alias("k")))

    by_start = F.sort_array(F.transform("found", lambda x: F.struct(x["start"].cast("int").alias("a"), x["end"].cast("int").alias("b"), x["k"].alias("k"))))
    rows = rows.withColumn("merged", F.when(F.size("found") > 0, F.aggregate(by_start, first, step, flush)))
    # Before each span: the text from the end of the one before it.
    at = lambda i: F.coalesce(F.get("merged", i - 1)["b"], F.lit(0))
    pieces = F.transform("merged", lambda x, i: F.concat(F.substring(F.col("text"), at(i) + 1, x["a"] - at(i)), F.lit("["), F.upper(_name(x["k"])), F.lit("]")))
    rest = F.substring(F.col("text"), F.element_at("merged", -1)["b"] + 1, F.length("text"))
    return rows.withColumn("clean", F.when(F.size("found") > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(F.col("text")))


_SPANS = "array<struct<k:int,start:bigint,end:bigint>>"


def document_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per (doc_id, h) of docs, h a hash of the text, that has any: spans, an array of (kind number,
    start, end), patterns' matches first, then terms that disclose one of the values found."""
    found = checkpoint(base_hits(docs, id_col, text_col).filter("kind IS NOT NULL"))
    base = checkpoint(_placed(found).filter(_valid()).select("doc_id", "h", "kind", "start", "end", "value"))
    terms = checkpoint(disclosing_terms(docs, base, id_col, text_col))
    spans = base.select("doc_id", "h", "kind", "start", "end")
    if not terms.isEmpty():
        spans = spans.unionByName(term_spans(docs, terms, id_col, text_col))
    return _ordered(spans)


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, found) of docs; found is what document_spans has, or empty."""
    per = document_spans(docs, id_col, text_col).withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    rows = _rows(docs, id_col, text_col)
    rows = rows.join(per, rows.doc_id.eqNullSafe(per._id) & (rows.h == per._h), "left")
    return rows.select("doc_id", "text", F.coalesce("spans", F.array().cast(_SPANS)).alias("found"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_sha256
    (of the text that ``sanitize`` gives).

    Patterns' matches are checked (IP parts, Luhn, digits of phones); terms that disclose one of
    the values found add spans of kind ``term`` wherever they stand. Positions are code points.

    Null texts count as empty (no spans); null and repeated ids keep their rows, each with the spans
    of its own text; an empty table gives no rows; other columns are not read.
    """
    rows = _cleaned(_with_spans(docs, id_col, text_col))
    of = lambda k: F.filter("found", lambda x: x["k"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    base = _written(F.filter("found", lambda x: x["k"] < len(PATTERNS)))
    return rows.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _written(F.col("found")).alias("spans"), F.sha2("clean", 256).alias("clean_sha256"))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id and text, in which values are generalised to their kind in capitals
    and brackets, and disclosing terms are removed in favour of [TERM]. Overlapping spans become
    one, named by the first.

    Null texts come back empty; rows that share an id, null included, are cut each by the spans of
    its own text; repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    return _cleaned(_with_spans(docs, id_col, text_col)).select("doc_id", F.col("clean").alias("text"))
