"""Language of web pages by fusing four kinds of evidence with Bayes' rule.

1. Text: a multinomial model over hashed words and byte trigrams, counted per language by grouped aggregation
   over all labelled documents, so that no language is missed.
2. Declaration: the language that the markup names (``lang`` of the html element, else a content-language or
   locale entry).
3. Address: the last label of the host and a language-like first part of the path.
4. Host: a prior per host, smoothed towards the one of its domain, and that towards the one of all pages.

How far 2 and 3 can be trusted is learned from the pages: their tables are expected counts of
language by declared value and by suffix, under the text evidence alone, grouped over all pages; so are the
host priors. A page's own text counts in these sums like that of any other page. No group is
collected: all tables are sums of a few numbers per key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.frames import table
from askloom.llm.html import host_of
from askloom.llm.words import U, Words, mix, portions
from askloom.session import materialize

BUCKETS = 1 << 16
# A task holds the counts of this many languages before it hands them on.
HELD_LANGUAGES = 64
# Texts are worth at most this many independent features; more of them say the same again.
MOST_WEIGHT = 60.0
SMOOTHING = 0.5
HOST_WEIGHT = 5.0
DOMAIN_WEIGHT = 20.0
TABLE_WEIGHT = 2.0

HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
MARKUP = re.compile(r"<[^>]*>")
DECLARED = (
    r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b",
    r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b",
    r"(?is)<meta\b[^>]*?og:locale[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b",
)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and byte trigrams, and for each the number of its text."""
    words = Words(texts, lower=True)
    text_of = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    length = words.end - words.start
    long = length > 0
    # trigrams over the bytes of each word and its borders; every byte of a word starts one
    first = np.repeat(words.start, length)
    inside = np.arange(len(first)) - np.repeat(np.cumsum(length) - length, length)
    at, end = first + inside, np.repeat(words.end, length)
    data = words.data
    pad = np.concatenate((data, np.zeros(2, np.uint8)))
    code = pad[at].astype(U)
    for k in (1, 2):
        code = code * U(257) + np.where(at + k < end, pad[np.minimum(at + k, len(pad) - 1)].astype(U), U(256))
    grams = mix(code + U(1)) % U(BUCKETS)
    wholes = mix(words.hashes[long]) % U(BUCKETS)
    return np.concatenate((grams, wholes)).astype(np.int64), np.concatenate((np.repeat(text_of, length), text_of))


def _counted(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(counts[some])], names=["lang", "bucket", "n"]
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in portions(batches, "text"):
        names, of = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
        bucket, text = features(batch.column("text"))
        order = np.argsort(of[text], kind="stable")
        bounds = np.searchsorted(of[text][order], np.arange(len(names) + 1))
        for k, lang in enumerate(names):
            if lang not in held:
                if len(held) == HELD_LANGUAGES:
                    yield from _counted(held)
                    held = {}
                held[lang] = np.zeros(BUCKETS, np.int64)
            held[lang] += np.bincount(bucket[order[bounds[k] : bounds[k + 1]]], minlength=BUCKETS)
    yield from _counted(held)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities ``[bucket, language]``; null languages and texts take no part."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket")
    got = counts.agg(F.sum("n").alias("n")).toArrow()  # languages x BUCKETS at most
    names = got.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    weights = np.full((BUCKETS, len(langs)), SMOOTHING)
    np.add.at(weights, (got.column("bucket").to_numpy(), np.array([place[x] for x in names], dtype=np.int64)), got.column("n").to_numpy())
    return langs, np.log(weights / weights.sum(axis=0)).astype(np.float32)


def plain(html: str | None) -> str:
    return unescape(MARKUP.sub(" ", HIDDEN.sub(" ", html or "")))


def _likelihoods(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "html"):
            texts = pa.array([plain(h) for h in batch.column("html").to_pylist()], pa.string())
            bucket, text = features(texts)
            n, m = len(texts), weights.shape[1]
            total = np.stack([np.bincount(text, weights[bucket, j], n) for j in range(m)], axis=1) if m else np.zeros((n, 0))
            count = np.bincount(text, minlength=n)
            total *= np.minimum(1.0, MOST_WEIGHT / np.maximum(count, 1))[:, None]
            total -= total.max(axis=1, keepdims=True, initial=-np.inf) if m else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "declared", "host", "domain", "suffix")), lists],
                names=["page_id", "url", "declared", "host", "domain", "suffix", "loglik"],
            )

    return run


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _sums(rows: DataFrame, keys: list[str], langs: int, name: str) -> DataFrame:
    """Expected counts per language under the text evidence, as an array per key."""
    each = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(langs)]
    return rows.groupBy(*keys).agg(*each).select(*keys, F.array(*[F.col(f"s{i}") for i in range(langs)]).alias(name))


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, url, lang, confidence, text_lang`` per row of ``pages`` (``page_id, url, html``).

    ``docs`` (``doc_id, text, lang``) teaches the text model and names the languages; without any, ``lang`` is null and
    the confidence 0. Null, empty and textless pages are judged by the other evidence; pages without
    address or declaration by the rest. Ties go to the language that sorts first. Repeated rows are
    all returned; other columns are ignored; an empty table gives no rows.
    """
    langs, weights = fit(docs)
    url = F.coalesce(F.col("url"), F.lit(""))
    declared = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), p, 1)), F.lit("")) for p in DECLARED], F.lit("-"))
    host = host_of(F.col("url"))
    top = F.regexp_extract(host, r"([^.]*)$", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#_-]|$)", 1)
    named = pages.select(
        "page_id", "url", "html", declared.alias("declared"), host.alias("host"),
        F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1).alias("domain"),
        F.concat_ws("/", top, F.lower(path)).alias("suffix"),
    )
    if not langs:
        nothing = F.lit(None).cast("string")
        return named.select("page_id", "url", nothing.alias("lang"), F.lit(0.0).alias("confidence"), nothing.alias("text_lang"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    judged = named.mapInArrow(
        _likelihoods(weights), f"{schema}, declared string, host string, domain string, suffix string, loglik array<double>"
    )
    judged = materialize(judged, "likelihoods")
    n = len(langs)
    soft = judged.select("declared", "host", "domain", "suffix", softmax(F.col("loglik")).alias("p"))
    by_host = _sums(soft, ["host", "domain"], n, "at_host")
    by_domain = _sums(by_host.withColumnRenamed("at_host", "p"), ["domain"], n, "at_domain")
    overall = _sums(by_domain.withColumnRenamed("at_domain", "p"), [], n, "overall")
    # one row; empty input leaves a null, and then there are no pages to join it to
    sums = lambda a: F.aggregate(F.col(a), F.lit(0.0), lambda s, x: s + x)

    def smoothed(own: str, base: Column, weight: float) -> Column:
        return F.transform(F.zip_with(own, base, lambda x, b: x + weight * b), lambda x: x / (sums(own) + weight))

    every = F.transform("overall", lambda x: (x + 1.0) / (sums("overall") + n))
    priors = by_host.join(by_domain, "domain").join(F.broadcast(overall), F.lit(True)).select(
        "host", smoothed("at_host", smoothed("at_domain", every, DOMAIN_WEIGHT), HOST_WEIGHT).alias("prior")
    )
    # P(value | language), its total over the languages smoothed towards the value's overall share
    def table_of(key: str, name: str) -> DataFrame:
        rows = _sums(soft, [key], n, "seen").join(F.broadcast(overall), F.lit(True))
        share = sums("seen") / sums("overall")
        chance = F.zip_with("seen", "overall", lambda x, t: F.log((x + TABLE_WEIGHT * share) / (t + TABLE_WEIGHT)))
        return rows.select(key, chance.alias(name))

    fused = (
        judged.join(priors, "host").join(table_of("declared", "by_declared"), "declared").join(table_of("suffix", "by_suffix"), "suffix")
    )
    total = F.zip_with(
        F.zip_with("loglik", F.transform("prior", lambda x: F.log(x)), lambda a, b: a + b),
        F.zip_with("by_declared", "by_suffix", lambda a, b: a + b),
        lambda a, b: a + b,
    )
    names = F.array(*[F.lit(x) for x in langs])
    first = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    out = fused.withColumn("_p", softmax(total))
    return out.select(
        "page_id", "url", first(F.col("_p")).alias("lang"), F.array_max("_p").alias("confidence"), first(F.col("loglik")).alias("text_lang")
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
