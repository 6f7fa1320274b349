"""Language identification by compression.

Every language has a few raw-content zstandard dictionaries, cut from a bounded
sample of its texts. A text is encoded in chunks with each dictionary; the
language whose dictionaries give the fewest bytes wins. The score is the margin
by which it beats the next language, mapped to 0..1; below ``reject_below`` the
operator's column ``accepted`` is false. Of more than SHORTLIST languages,
those whose dictionaries share most of its grams of GRAM bytes come first; the
others are encoded until they take more bytes than the second best, which they
can't come back from, so the result is that of all languages.

The model is bounded: at most ``max_languages`` languages are learned, the most
frequent, and their dictionaries share ``model_bytes``; the driver gathers about
SPARE times as many bytes of text, and a count for each lang value that occurs
(at most COUNTED of them).

Defined results: a text that is null or has no letter is ``und`` with score 0
and not accepted; ties go to the language with more training rows, then to the
lower code point; with no language learned every text is ``und``. Equal texts
get equal results, and other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, short_batches, table, texts

UND = "und"
#: Bytes of text that are gathered for each byte of a dictionary.
SPARE = 3
#: Languages up to which each text is encoded for all in their order, candidates that come first beyond; lang values that are counted in the driver; bytes of a gram and hash buckets.
SHORTLIST, CANDIDATES, COUNTED = 16, 8, 20_000
GRAM, BUCKETS = 4, 1 << 13
SPLIT = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """dictionaries: of each language, in order of preference."""

    dictionaries: tuple[tuple[str, tuple[bytes, ...]], ...]
    chunk: int = 2048
    level: int = 5
    reject_below: float = 0.02


def has_letter(text: str) -> bool:
    """A character of Unicode's category L; digits, fractions and Roman-numeral signs are none."""
    return any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    """What is encoded: lower-case words, single spaces."""
    return f" {' '.join(SPLIT.split(text.lower()))} ".encode()


def grams(raw: bytes) -> np.ndarray:
    """How often each bucket of hashed grams occurs."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(a) < GRAM:
        return np.zeros(BUCKETS, np.float32)
    h = sum((a[i : len(a) - GRAM + 1 + i] << np.uint64(8 * i) for i in range(1, GRAM)), a[: len(a) - GRAM + 1].copy())
    return np.bincount((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), minlength=BUCKETS).astype(np.float32)


class Encoder:
    """The compressors of a model; made once in a task."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.coders = []
        for lang, parts in model.dictionaries:
            own = []
            for raw in parts:
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=model.level)
                own.append(zstandard.ZstdCompressor(dict_data=d, level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False))
            self.coders.append((lang, own))
        self.known = None
        if len(self.coders) > SHORTLIST:
            # rare grams tell more; of every language the same weight
            has = np.stack([sum(map(grams, parts)) > 0 for _, parts in model.dictionaries])
            self.known = has * np.log((1 + len(has)) / (1 + has.sum(axis=0, keepdims=True))).astype(np.float32)

    def candidates(self, raw: bytes) -> list[int]:
        """Languages that a text is encoded for first."""
        if self.known is None:
            return list(range(len(self.coders)))
        return sorted(np.argsort(-(self.known @ np.minimum(grams(raw), 8)), kind="stable")[:CANDIDATES].tolist())

    def size(self, i: int, pieces: list[bytes], most: int) -> int | None:
        """Bytes that language i takes; None once they are more than ``most``."""
        n = 0
        for c in self.coders[i][1]:
            for p in pieces:
                n += len(c.compress(p))
                if n > most:
                    return None
        return n

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.coders or not has_letter(text):
            return UND, 0.0, False
        raw = folded(text)
        step = self.model.chunk
        pieces = [raw[i : i + step] for i in range(0, len(raw), step)]
        sizes = {i: sum(len(c.compress(p)) for c in self.coders[i][1] for p in pieces) for i in self.candidates(raw)}
        for i in range(len(self.coders)):
            if i not in sizes and (n := self.size(i, pieces, sorted(sizes.values())[1])) is not None:
                sizes[i] = n
        order = sorted(sizes, key=lambda i: (sizes[i], i))
        best = order[0]
        if len(order) == 1:
            return self.coders[best][0], 1.0, True
        margin = 1 - sizes[best] / max(1, sizes[order[1]])
        return self.coders[best][0], margin / (margin + 0.05), margin >= self.model.reject_below


def fit_language(docs: DataFrame, *, dictionary_bytes: int = 65_536, parts: int = 2, max_languages: int = 2048, max_bytes: int = 16_384, model_bytes: int = 64 << 20) -> LanguageModel:
    """Learn from text and non-null ``lang`` of ``docs`` (held-out rows left away by the caller).

    The ``max_languages`` most frequent languages with a letter in some text; for each ``parts`` dictionaries of ``dictionary_bytes`` bytes, from
    texts of at most ``max_bytes`` bytes (where a language has none, from the
    beginnings of longer ones) in the order of a hash of doc_id and text. What is too
    short is repeated, so that all dictionaries are equally long; they are shorter
    where all of them would take more than ``model_bytes``. Two scans,
    whatever the number of languages; the driver gets about SPARE times the
    bytes of all dictionaries (64 texts of a language at least)."""
    rows = docs.filter("lang is not null and doc_id is not null").filter(F.col("text").rlike(r"\p{L}"))
    length = F.octet_length("text")
    short = length <= max_bytes
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("n"), F.sum(F.when(short, length)).alias("bytes")).orderBy(F.desc("n"), "lang").limit(COUNTED).collect()
    counts = sorted(counts, key=lambda r: (-(r["short"] or r["n"]), r["lang"]))[:max_languages]
    langs = [r["lang"] for r in counts]
    if not langs:
        return LanguageModel(())
    dictionary_bytes = max(1024, min(dictionary_bytes, model_bytes // (parts * len(langs))))
    # of each language a share by the hash of doc_id, so that some SPARE times the bytes of its dictionaries are expected
    share = []
    for r in counts:
        n, size = (r["short"], r["bytes"]) if r["short"] else (r["n"], r["n"] * max_bytes // 4)
        share.append(min(1.0, max(SPARE * parts * dictionary_bytes / size, 64 / n)))
    long = [r["lang"] for r in counts if not r["short"]]
    order = F.xxhash64("doc_id", "text", F.lit(23))
    limits = F.create_map(*[x for lang, p in zip(langs, share, strict=True) for x in (F.lit(lang), F.lit(int(p * 1_000_000) + 1))])
    taken = rows.filter(F.col("lang").isin(langs)).filter(short | F.col("lang").isin(long)).filter(F.pmod(order, F.lit(1_000_000)) < limits[F.col("lang")])
    text = F.when(short, F.col("text")).otherwise(F.substring("text", 1, max_bytes // 4))
    found = taken.select("lang", text.alias("text"), order.alias("h")).toPandas()
    out = []
    for lang in langs:
        mine = found[found["lang"] == lang].sort_values(["h", "text"])["text"]
        own = []
        for k in range(parts):
            raw = b""
            for t in mine[k::parts]:
                if len(raw) >= dictionary_bytes:
                    break
                if has_letter(t):
                    raw += folded(t)
            own.append(raw[:dictionary_bytes])
        own = [x for x in own if x]
        if own:
            out.append((lang, (own * parts)[:parts]))
    size = max((len(x) for _, own in out for x in own), default=0)
    return LanguageModel(tuple((lang, tuple((x * -(-size // len(x)))[:size] for x in own)) for lang, own in out))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred, score and accepted; columns of these names are replaced."""
    short_batches(docs.sparkSession)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = [f.name for f in new]
    out = T.StructType([f for f in docs.schema.fields if f.name not in names] + new)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for b in it:
            got = [coder.predict(t.decode(errors="replace")) for t in texts(b)]
            keep = [n for n in b.schema.names if n not in names]
            new_cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + new_cols, names=keep + names)

    return docs.mapInArrow(run, out)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned without rows whose crc32 mod 4 is 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = fit_language(docs.select("doc_id", "text", "lang").filter(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "accepted")
