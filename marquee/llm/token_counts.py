"""Token counts of whole texts, huge ones in overlapping chunks that are resynchronised.

A text of up to ``step + overlap`` code points is encoded in one piece. A longer one is cut
into chunks that start at 0, step, 2 step, ... and reach ``overlap`` code points into the
next one; the chunks are rows of their own, so one document is encoded by many tasks.

Let f_k(p) be the number of tokens that a scan from the start of chunk k makes up to p. The
text has f_0(end) tokens, which is the sum of [f_k(end) - f_{k+1}(end)] over all chunks but
the last, plus f_last(end). If both scans have a word boundary at p, they go on alike from
p, so the difference at the end is the difference at p, and it is known from the overlap
alone: every pair of neighbours is spliced by itself, in the task that holds its chunk.

A boundary at p is proven stable when
* words (the pieces that the merges never cross) are found from left to right by a pattern
  that looks ahead only, so that what follows a boundary does not depend on what precedes it;
* the boundary lies ``margin`` code points before the end of a cut chunk, further than the
  pattern and the added tokens look ahead.
``margin_of`` reads from the tokenizer file whether this holds (byte-level pattern, no
normaliser, added tokens that cannot overlap each other). Where it does not, texts are
encoded whole.

Where the overlap has no common boundary (a word longer than the overlap), the pair stays
open: open neighbours are merged, the overlap is widened to 1, 4, 16, ... steps, gathered
again from the stored chunks, until the pair closes, at the latest at the end of the text.
So every count is exact, whatever the text.

Texts of one piece are counted by units (words, or runs of what cannot be cut safely); a task encodes a
frequent one once (``_units``).

Defined cases: null counts as the empty text (0 bytes, 0 tokens); rows that repeat, by id or
wholly, and rows with a null id are rows of their own and all returned; special strings
inside texts are what the library makes of them by default (one token each); a very long
text is spread over chunks, except that one unbroken word is one unit; an empty table gives
an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, read_table

TOKENIZER = "byte_bpe_50k.json"
STEP, OVERLAP = 16_384, 1_024     # code points
BATCH = 1 << 18                   # code points encoded by one call
UNITS, OFTEN = 200_000, 4         # units that a task remembers at most, besides those of the texts at hand
_CUT_UNITS = re.compile(r"(?<=[\w!-~])(?= )")
LIMIT = 512                       # tokens beyond which the query marks a document


def tokenizer_file(name: str) -> str:
    """A path as it is; a bare name among the public tokenizers installed on the executor."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _overlapping(tokens: list[str]) -> bool:
    """Whether two added tokens can stand in a text so that they overlap."""
    for a in tokens:
        for b in tokens:
            if a != b and a in b or any(a.endswith(b[:i]) for i in range(1, min(len(a), len(b)))):
                return True
    return False


def margin_of(spec: dict) -> int | None:
    """Code points that a scan looks ahead at most; None where common boundaries prove nothing."""
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"].get("dropout") or spec["model"].get("type") != "BPE":
        return None
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        return None
    strings = [t["content"] for t in added]
    return None if _overlapping(strings) else max([1, *map(len, strings)]) + 3


@lru_cache(maxsize=2)
def load(name: str):
    """(tokenizer, margin), once a worker; one thread, as Spark runs a task on each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, processors
    path = tokenizer_file(name)
    with open(path, encoding="utf-8") as f:
        margin = margin_of(json.load(f))
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    if margin is not None:
        tok.post_processor = processors.ByteLevel(trim_offsets=False)   # offsets of words with their space
    return tok, margin


def boundaries(tok, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, tokens before it) of every word boundary of a text, its end included."""
    e = tok.encode(text, add_special_tokens=False)
    if not len(e):
        return np.array([len(text)]), np.array([0])
    word = np.array(e.word_ids, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    at = np.array([a for a, _ in e.offsets], dtype=np.int64)[first]
    return np.append(at, len(text)), np.append(first, len(word))


def splice(tok, margin: int, text: str, start: int, ends: bool) -> int | None:
    """f_a(p) - f_b(p) at a boundary p that the scans from 0 and from ``start`` share; None if there is none.

    ``ends`` says that the text is not cut at its end.
    """
    pa_, ca = boundaries(tok, text)
    pb, cb = boundaries(tok, text[start:])
    stop = len(text) if ends else len(text) - margin
    _, i, j = np.intersect1d(pa_, pb + start, return_indices=True)
    ok = np.flatnonzero((pa_[i] >= start) & (pa_[i] <= stop))
    return int(ca[i[ok[0]]] - cb[j[ok[0]]]) if len(ok) else None


def _units(tok, texts: list[str], known: dict[str, int], seen: Counter) -> list[int]:
    """Tokens of texts as sums over their units: a unit met ``OFTEN`` times is encoded once and its count
    remembered, the others of a text are encoded together.

    Units are cut before a space that follows a letter, digit or ASCII sign. A word of the byte-level pattern holds
    a space only at its start or among white space, and the pattern looks ahead only in white space, so
    such a cut is a word boundary of every text, also with other units left out (``separable`` leaves out
    added tokens with a space).
    """
    cut = [_CUT_UNITS.split(t) for t in texts]
    rest = [[u for u in units if u not in known] for units in cut]
    for units in rest:
        seen.update(units)
    new = list({u for units in rest for u in units if seen[u] >= OFTEN})
    known.update(zip(new, _whole(tok, new)))
    counts = _whole(tok, ["".join([u for u in units if u not in known]) for units in rest])
    out = [n + sum([known[u] for u in units if u in known]) for n, units in zip(counts, cut)]
    for table in (known, seen):
        if len(table) > UNITS:
            table.clear()
    return out


def separable(tok, margin: int | None) -> bool:
    """Whether counts of units add up: proven word boundaries, no added token across one."""
    return margin is not None and not any(" " in t.content for t in tok.get_added_tokens_decoder().values())


def _whole(tok, texts: list[str]) -> list[int]:
    """Tokens of texts encoded in one piece, a bounded number of code points at a time."""
    out, i = [], 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH):
            size += len(texts[j])
            j += 1
        out += [len(e) for e in tok.encode_batch_fast(texts[i:j], add_special_tokens=False)]
        i = j
    return out


_CUT = "n_bytes long, n_tokens long, key long, k long, last long, piece string"


def _cut(name: str, step: int, overlap: int):
    """Rows (id, text) -> counted rows (key null), and the chunks of longer texts."""
    names = ["_id", *[f.name for f in T.StructType.fromDDL(_CUT).fields]]

    def ints(values):
        return pa.array(values, pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, margin = load(name)
        part, seen = TaskContext.get().partitionId(), 0
        known, often = ({}, Counter()) if separable(tok, margin) else (None, None)
        for b in batches:
            for at in range(0, b.num_rows, 256):     # few texts at a time as Python strings
                piece = b.slice(at, 256)
                ids, texts = piece.column(0), [t or "" for t in piece.column(1).to_pylist()]
                n_bytes = [len(t.encode()) for t in texts]
                short = [i for i, t in enumerate(texts) if margin is None or len(t) <= step + overlap]
                taken = [texts[i] for i in short]
                counts = _whole(tok, taken) if known is None else _units(tok, taken, known, often)
                none = [None] * len(short)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(ints(short)), ints([n_bytes[i] for i in short]), ints(counts),
                     ints(none), ints(none), ints(none), pa.array(none, pa.string())], names)
                for i in sorted(set(range(len(texts))) - set(short)):
                    key, t = (part << 40) + seen, texts[i]
                    seen += 1
                    last = -(-(len(t) - overlap) // step) - 1     # the last chunk ends with the text
                    for a in range(0, last + 1, 64):
                        ks = list(range(a, min(a + 64, last + 1)))
                        m = len(ks)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(ints([i] * m)), ints([n_bytes[i]] * m), ints([None] * m), ints([key] * m), ints(ks), ints([last] * m),
                             pa.array([t[k * step:(k + 1) * step + overlap] for k in ks], pa.string())], names)
    return run


_SPLICED = "key long, a long, b long, tokens long"


def _spliced(name: str, step: int):
    """Spans (key, a, b, ends, piece) -> what each adds to its text's count; null where it stays open.

    A span starts with chunk a and reaches into chunk b; b is null for the last chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, margin = load(name)
        for batch in batches:
            rows = {"key": [], "a": [], "b": [], "tokens": []}
            for r in range(batch.num_rows):
                key, a, b, ends, piece = (batch.column(c)[r].as_py() for c in range(5))
                got = len(tok.encode(piece, add_special_tokens=False)) if b is None else splice(tok, margin, piece, (b - a) * step, ends)
                for c, v in (("key", key), ("a", a), ("b", b), ("tokens", got)):
                    rows[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))
    return run


def _widened(ws: Workspace, pieces: DataFrame, spans: DataFrame, step: int, reach: int) -> DataFrame:
    """Open spans, neighbours merged, with the text from chunk a to ``reach`` chunks beyond the start of b."""
    order = Window.partitionBy("key").orderBy("a")
    new = F.coalesce((F.lag("b").over(order) != F.col("a")).cast("int"), F.lit(1))
    islands = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(order))
    merged = islands.groupBy("key", "_g").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_g")
    wanted = merged.select("key", "a", "b", F.explode(F.sequence("a", F.col("b") + F.lit(reach - 1))).alias("k"))
    # a chunk without its overlap, but for the last, whose rest belongs to no other
    core = F.when(F.col("k") == F.col("last"), F.col("piece")).otherwise(F.substring("piece", 1, step))
    parts = pieces.select("key", "k", "last", core.alias("_t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "_t"))), lambda x: x["_t"]), "")
    return (wanted.join(parts, ["key", "k"]).groupBy("key", "a", "b")
            .agg((F.max("k") == F.max("last")).alias("ends"), text.alias("piece")))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                 step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, in no order."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *T.StructType.fromDDL(_CUT).fields])
    cut = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(_cut(tokenizer, step, overlap), schema)
    path = ws.path("cut")
    # small row groups: the chunks of one document are read by many tasks
    cut.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    pieces = rows.filter(F.col("key").isNotNull())
    spans = pieces.select("key", F.col("k").alias("a"), F.when(F.col("k") < F.col("last"), F.col("k") + 1).alias("b"),
                          F.lit(False).alias("ends"), "piece")
    counted, reach = [], 1
    while True:
        done = ws.save(spans.mapInArrow(_spliced(tokenizer, step), _SPLICED), "spliced")
        counted.append(done.filter(F.col("tokens").isNotNull()).select("key", "tokens"))
        left = done.filter(F.col("tokens").isNull())
        if left.isEmpty():
            break
        spans = _widened(ws, pieces, left, step, reach)
        reach *= 4
    sums = counted[0]
    for c in counted[1:]:
        sums = sums.unionByName(c)
    sums = sums.groupBy("key").agg(F.sum("tokens").alias("n_tokens"))
    long = pieces.filter("k = 0").select("key", "_id", "n_bytes").join(sums, "key")
    columns = [F.col("_id").alias(id_col), "n_bytes", "n_tokens"]
    return rows.filter(F.col("key").isNull()).select(*columns).unionByName(long.select(*columns))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all ``documents``."""
    out = token_counts(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
