"""Source contents: canonical bodies, revisions, passages, and vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgraph.functions.text import canonical_body, content_tokens
from factgraph.operators import gram_index, vector_index
from factgraph.operators.segments import Segments
from factgraph.session import written


def _numbered(ingests: DataFrame) -> DataFrame:
    """Ingests that differ from the one before them, numbered; a source of any size takes many tasks."""
    body = canonical_body(F.col("content"))
    rows = ingests.filter("content IS NOT NULL AND content <> ''").select("source_id", "ingest_id", "captured_at", "content_format", F.sha2(body, 256).alias("content_hash"))
    # Written first, as dealing by range reads its input twice.
    placed = Segments(written(rows, "hashes"), ["source_id"], ["captured_at", "ingest_id"]).before("content_hash", "content_format")
    same = F.col("_before").isNotNull() & F.col("_before.content_hash").eqNullSafe(F.col("content_hash")) & F.col("_before.content_format").eqNullSafe(F.col("content_format"))
    return placed.filter(~same).running(F.lit(1), "revision").select("source_id", "ingest_id", "content_hash", "captured_at", F.col("revision").cast("int").alias("revision"), "content_format")


def revisions(ingests: DataFrame) -> DataFrame:
    """Content revisions of each source: an ingest whose hash and format equal those of the one
    before it is no revision; the others are numbered from 1 in order of capture."""
    return _numbered(ingests).drop("content_format")


def latest(revised: DataFrame) -> DataFrame:
    """The last revision of each source."""
    return revised.groupBy("source_id").agg(F.max("revision").alias("revision"), F.max_by("content_hash", "revision").alias("content_hash"), F.max_by("ingest_id", "revision").alias("ingest_id"))


def append_revisions(existing: DataFrame, ingests: DataFrame) -> DataFrame:
    """What ingests add to existing revisions (as ``revisions`` gives them, or with content_format, which
    then counts too): an ingest that equals its source's newest revision adds nothing, others go on
    counting from it."""
    kind = F.col("content_format") if "content_format" in existing.columns else F.lit(None).cast("string")
    newest = existing.groupBy("source_id").agg(F.max("revision").alias("_last"), F.max_by(F.struct("content_hash", kind.alias("content_format")), "revision").alias("_same"))
    added = _numbered(ingests).join(newest, "source_id", "left")
    # Only the first of a source's new revisions can repeat what is there; the others follow it.
    again = F.coalesce((F.col("revision") == 1) & (F.col("content_hash") == F.col("_same.content_hash")) & F.coalesce(F.col("content_format") == F.col("_same.content_format"), F.col("_same.content_format").isNull()), F.lit(False))
    added = written(added.withColumn("_again", again), "added")
    left_out = added.filter("_again").select("source_id", F.lit(1).alias("_left"))
    added = added.filter("NOT _again").join(left_out, "source_id", "left").withColumn("_left", F.coalesce("_left", F.lit(0)))
    return added.withColumn("revision", F.col("revision") + F.coalesce("_last", F.lit(0)) - F.col("_left")).drop("_last", "_same", "_again", "_left", "content_format")


def newest_content(ingests: DataFrame) -> DataFrame:
    """The newest ingest with content of each source: source_id, ingest_id."""
    return ingests.filter("content <> ''").groupBy("source_id").agg(F.max_by("ingest_id", F.struct("captured_at", "ingest_id")).alias("ingest_id"))


def newest_by_hash(revised: DataFrame) -> DataFrame:
    """The newest revision of each source and content hash; older repeats go."""
    return revised.groupBy("source_id", "content_hash").agg(F.max("revision").alias("revision"), F.max_by("ingest_id", "revision").alias("ingest_id"))


#: Queries of so few words and characters in all are broadcast to the texts.
ASKED_ROWS, ASKED_CHARS = 100_000, 8 << 20


def passages(texts: DataFrame, queries: DataFrame, around: int = 40) -> DataFrame:
    """Texts (text_id, text) that contain a query (query_id, query), in any case: where first, and the
    text around it.

    A query's first and last words may be parts of words of the text, but those between stand there
    whole. Of these each query is looked up by its rarest, by the number of texts that have it; texts
    that have the word are searched where they are read, and are not shuffled unless the queries are
    too many to broadcast (then only their words are). Queries of one or two words are looked up in
    a gram index of the texts. Queries that are blank find nothing.
    """
    low = texts.select("text_id", "text", F.lower("text").alias("low"))
    inner = F.slice(F.split("q", r"\s+"), 2, 1 << 30)
    asked = queries.select("query_id", F.lower("query").alias("q")).filter(F.trim("q") != "").withColumn("inner", F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))))
    asked = written(asked, "asked-passages")
    rows, chars, short = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("q")), F.lit(0)), F.coalesce(F.max(F.size("inner") == 0), F.lit(False))).first()
    few = rows <= ASKED_ROWS and chars <= ASKED_CHARS
    sent = F.broadcast if few else lambda x: x
    words = F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word")
    named = asked.select("query_id", F.explode(F.array_distinct("inner")).alias("word"))
    seen = low.select(words).join(sent(named.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("n"))
    # A query with a word that no text has finds nothing.
    rarest = named.join(seen, "word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("word"))).alias("_r"))
    keys = written(asked.join(rarest.filter("_r.n > 0").select("query_id", F.col("_r.word").alias("word")), "query_id").select("query_id", "q", "word"), "rarest-words")
    if few:
        met = low.select("text_id", "text", "low", words).join(F.broadcast(keys), "word")
    else:
        met = low.join(low.select("text_id", words).join(keys, "word").select("text_id", "query_id", "q"), "text_id")
    met = met.select("query_id", "q", "text_id", "text", "low").filter(F.contains("low", F.col("q")))
    if short:
        index = gram_index.build(texts.select("text"))
        small = asked.filter(F.size("inner") == 0).select("query_id", "q")
        found = index.matches(small.select(F.col("q").alias("pattern"))).select("pattern", F.col("text_id").alias("_text"))
        by_text = low.withColumn("_text", gram_index.text_id(F.col("text"))).join(found.join(small, F.col("pattern") == F.col("q")), "_text")
        met = met.union(by_text.select("query_id", "q", "text_id", "text", "low"))
    at = F.instr(F.col("low"), F.col("q"))
    start = F.greatest(at - around, F.lit(1))
    found = met.select("query_id", "text_id", at.alias("at"), F.substring(F.col("text"), start, F.length("q") + 2 * around).alias("passage"))
    return found.dropDuplicates(["query_id", "text_id", "at"])


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, markdown of (page_id, html): headings, links, list items and paragraphs as Markdown."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"page_id": part.page_id, "markdown": [markdown(x) for x in part.html]})

    return pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).mapInPandas(run, "page_id long, markdown string")


# Elements that go with all they hold, that never hold anything, and whose text is a block.
GONE = {"script", "style", "noscript", "head", "meta", "link"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "body", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "html", "main", "nav", "section"}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*"}


#: Levels of elements; deeper ones stand beside each other.
DEEPEST = 150


class _Tree(HTMLParser):
    """Elements as (tag, attributes, children); an end tag closes what stands open inside its element."""

    def __init__(self, html: str):
        super().__init__()
        self.top = ("", {}, [])
        self.open = [self.top]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        self.open[-1][2].append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _raw(node) -> str:
    return node if isinstance(node, str) else "".join(map(_raw, node[2]))


def _joined(parts: list[tuple[bool, str]]) -> str:
    """Inline parts run on; a block stands between blank lines."""
    out, before = "", False
    for block, text in parts:
        out += ("\n\n" if out and (block or before) and text else "") + (text.lstrip(" ") if before and not block else text)
        before = (block or before and not text) if text or before else before
    return out


def _flat(node, depth: int = 0) -> str:
    """An element's content on one line."""
    return re.sub(r"\s+", " ", _joined([x for child in node[2] for x in _parts(child, depth)])).strip()


def _listed(node, depth: int) -> str:
    lines, indent = [], "  " * depth
    for k, item in enumerate((x for x in node[2] if not isinstance(x, str) and x[0] == "li"), 1):
        text = re.sub(r"\n+", "\n", _joined([x for child in item[2] for x in _parts(child, depth + 1)]).strip())
        first, *rest = text.split("\n")
        lines += [f"{indent}{f'{k}.' if node[0] == 'ol' else '-'} {first}", *[f"{indent}  {x}" for x in rest]]
    return "\n".join(lines)


def _rows(node) -> list[str]:
    """Rows of a table at any depth, cells apart by bars."""
    if isinstance(node, str):
        return []
    if node[0] == "tr":
        cells = [_flat(x) for x in node[2] if not isinstance(x, str) and x[0] in ("td", "th")]
        return [" | ".join(cells)] if cells else []
    return [row for child in node[2] for row in _rows(child)]


def _parts(node, depth: int) -> list[tuple[bool, str]]:
    """What a node gives: (whether it is a block, Markdown)."""
    if isinstance(node, str):
        return [(False, re.sub(r"[ \t\r\n\f\v]+", " ", node))]
    tag, attrs, children = node
    if tag in GONE:
        return []
    if tag in MARKS:
        return [(False, f"{MARKS[tag]}{_flat(node)}{MARKS[tag]}")]
    if tag == "a":
        return [(False, f"[{_flat(node)}]({attrs['href']})" if attrs.get("href") else _flat(node))]
    if tag == "code":
        return [(False, "`" + _raw(node).replace("`", "\\`") + "`")]
    if tag == "br":
        return [(False, "\n")]
    block = None
    if tag == "hr":
        block = "---"
    elif re.fullmatch("h[1-6]", tag):
        block = "#" * int(tag[1]) + " " + _flat(node)
    elif tag == "p":
        block = _flat(node)
    elif tag == "li":
        block = "- " + _flat(node)
    elif tag == "pre":
        block = "```\n" + _raw(node).rstrip("\n") + "\n```"
    elif tag in ("ul", "ol"):
        block = _listed(node, depth)
    elif tag == "table":
        block = "\n".join(_rows(node))
    inner = [] if block is not None else [x for child in children for x in _parts(child, depth)]
    if tag == "blockquote":
        block = "\n".join(f"> {x}" for x in _joined(inner).strip("\n").split("\n")) if _joined(inner).strip() else ""
    elif tag in BLOCKS and any(text.strip() for _, text in inner):
        block = _joined(inner).strip()
    return [(True, block)] if block is not None else inner


def markdown(html: str) -> str:
    """Markdown of one page: headings, paragraphs, quotes, code, nested lists, links, emphasis and tables;
    scripts, styles and heads go. Lines end without blanks, no two blank lines follow each other, and a
    text ends with one line feed."""
    text = _joined([x for node in _Tree(html).top[2] for x in _parts(node, 0)])
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")
    return text.strip() + "\n" if text.strip() else ""


def hashed_embeddings(texts: DataFrame, dims: int = 32) -> DataFrame:
    """text_id, embedding: content tokens hashed to a place and a sign by SHA-256, summed and scaled
    to length 1; a text without tokens has zeros."""
    tokens = texts.select("text_id", F.explode_outer(content_tokens(F.col("text"))).alias("t"))
    digest = F.sha2("t", 256)
    byte = lambda k: F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("int")
    hit = tokens.select("text_id", (byte(0) % dims).alias("k"), F.when(byte(1) % 2 == 0, 1).otherwise(-1).alias("v"))
    sums = hit.groupBy("text_id").agg(*[F.coalesce(F.sum(F.when(F.col("k") == i, F.col("v"))), F.lit(0)).alias(f"_{i}") for i in range(dims)])
    vector = F.array(*[F.col(f"_{i}").cast("double") for i in range(dims)])
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return sums.select("text_id", F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector).alias("embedding"))


#: Embeddings by name: each takes (text_id, text) and gives (text_id, embedding). Others are added by
#: ``register_provider``, such as one that calls a model in batches.
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hashed": hashed_embeddings}


def register_provider(name: str, provider: Callable[[DataFrame], DataFrame]) -> None:
    PROVIDERS[name] = provider


def embedded(texts: DataFrame, provider: str = "hashed") -> DataFrame:
    """Rows of the embedding table for (text_id, text): text_id, model, content_hash, embedding."""
    hashes = texts.select("text_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return PROVIDERS[provider](texts).join(hashes, "text_id").select("text_id", F.lit(provider).alias("model"), "content_hash", "embedding")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """The k vectors (vec_id, embedding) of the highest cosine with each query, at least so near;
    ties go to the smaller id, and a query is no neighbour of its own id. Exact, by the cells of an
    index built for it."""
    return vector_index.build(vectors).search(queries, k, least)
