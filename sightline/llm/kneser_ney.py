"""Document quality by an interpolated modified Kneser-Ney n-gram model.

The model is over characters, trained on all trusted text of the corpus. A
character is one symbol of 12 bits, or two from U+07C0 up (Chinese, kana, Hangul,
Indic and others), so that an n-gram of up to five symbols is one long whose low
bits are its suffix and whose high bits are its context. No two characters have
the same symbols.

1. A scan of the documents gives, for each partition, its distinct n-grams
   and how often each occurs in trusted documents.
2. Summed counts, continuation counts of the lower orders, counts of counts
   and context totals are aggregations sharded by n-gram or context. The
   probabilities of all n-grams asked for come from joins of these shards,
   order by order; no table of the model is ever in one place.
3. The answers go back to each partition as one sorted table in the shared
   checkpoint folder. A second scan of the partition adds up the log
   probabilities of its documents. The texts themselves are never shuffled.

Perplexities are compared with quantiles of held-out trusted documents in the
same language. A language without enough of them is not judged: its documents
are kept. A partition must hold the same documents in both scans, as files
do: other input is written down first, and a partition with other documents
than before is an error, not a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fs_of, pinned, saved, slices, unique_ids, without

#: Order of the model and bits of a symbol.
ORDER, BITS = 5, 12
#: Characters of a document that count as much as the document itself: a
#: short text is drawn towards its language's mean.
PRIOR = 300
#: One in this many trusted documents is not trained on: the quantiles are
#: those of documents that the model has not seen.
HELD_OUT = 5
#: Quantile of the held-out documents, and how many times its distance from
#: their median is tolerated.
QUANTILE, SLACK = 0.99, 2.0
#: Fewest held-out documents of a language for bounds of its own.
LEAST_HELD_OUT = 50
#: Fewest held-out documents of a language for any judgement of it. With fewer
#: the model has seen little or nothing of the language, so that its ordinary
#: prose looks like junk, and nothing tells by how much.
LEAST_TO_JUDGE = 5
#: Most languages whose rules (a row each) are broadcast.
BROADCAST_LANGUAGES = 100_000

_PAD = "\x02"
_SYMBOLS = 1 << BITS
#: Symbols from here on are the first (by 1,024 code points) and the second
#: (within these) of two.
_FIRST = 1984
_SECOND = _FIRST + (0x110000 >> 10)


def symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a text, and how many each character has."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = cp >= _FIRST
    size = 1 + wide
    x = np.repeat(cp, size)
    last = np.cumsum(size)[wide] - 1
    x[last - 1] = _FIRST + (cp[wide] >> 10)
    x[last] = _SECOND + (cp[wide] & 1023)
    return x, size


def _ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams that end at each symbol, the index of its text, and the number
    of characters of each text. White space counts as one space; contexts
    before a text are padding."""
    start = _PAD * (ORDER - 1)
    clean = [start + " ".join(t.replace(_PAD, "\x03").split()) for t in texts]
    length = np.fromiter(map(len, clean), np.int64, len(clean))
    x, size = symbols("".join(clean))
    text = np.repeat(np.repeat(np.arange(len(texts)), length), size)
    g = x.copy()
    for k in range(1, ORDER):
        g[k:] |= x[:-k] << (BITS * k)
    real = x != ord(_PAD)
    return g[real], text[real], length - (ORDER - 1)


def _texts(col: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    col = col.cast(pa.large_string()).fill_null("")
    for i, j in slices(col, 1 << 19):
        yield i, j, col.slice(i, j - i).to_pylist()


# --- tables of a partition, in the shared folder ---------------------------

def _save_side(rows: DataFrame, root: str, columns: list[str]) -> None:
    """One file per ``part`` with the sorted columns of its rows."""
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        fs, folder = fs_of(root)
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/{part}.{_attempt()}.tmp"
        t = t.select(columns).sort_by(columns[0]).combine_chunks()
        with fs.open_output_stream(own) as out, pa.ipc.new_file(out, t.schema) as w:
            w.write_table(t)
        fs.move(own, f"{folder}/{part}.arrow")
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([t.num_rows], pa.int64())})

    rows.groupBy("part").applyInArrow(run, "part int, n long").agg(F.sum("n")).collect()


def _attempt() -> int:
    from pyspark import TaskContext
    return TaskContext.get().taskAttemptId()


def _load_side(root: str, part: int) -> list[np.ndarray]:
    """The columns of a partition's file; none if it has no rows."""
    from pyarrow import fs as pafs
    fs, folder = fs_of(root)
    name = f"{folder}/{part}.arrow"
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return []
    with fs.open_input_file(name) as f:
        t = pa.ipc.open_file(f).read_all()
    return [c.combine_chunks().to_numpy(zero_copy_only=False) for c in t.columns]


class _Seen:
    """Number and combined bits of the ids of a partition, to know it by."""

    def __init__(self):
        self.n = self.bits = 0

    def add(self, ids: pa.Array) -> np.ndarray:
        own = ids.fill_null(-1).to_numpy(zero_copy_only=False)
        self.n += len(own)
        self.bits ^= int(np.bitwise_xor.reduce(own)) if len(own) else 0
        return own

    def check(self, root: str, part: int) -> None:
        """Whether these are the rows that the partition had when its trusted
        documents were looked up."""
        n, bits = [int(x[0]) for x in _load_side(root, part)] or (0, 0)
        if (self.n, self.bits) != (n, bits):
            raise RuntimeError("a partition of the documents changed between two scans; score a table that is written down")


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain scan of files, whose partitions hold the same
    rows each time; else a written copy. Rows that were shuffled or computed
    may be dealt differently by each scan."""
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()}
    return docs if nodes <= {"Project", "Filter", "FileScan"} else saved(docs, "documents")


def _part() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


# --- the model -------------------------------------------------------------

def ngram_counts(docs: DataFrame, trusted_root: str) -> DataFrame:
    """(part, g, c): the distinct n-grams of each partition and their counts in
    its trusted documents. ``docs``: doc_id, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _part()
        ids = (_load_side(trusted_root, part) or [np.zeros(0, np.int64)])[0]
        g, c = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> tuple[np.ndarray, np.ndarray]:
            u = np.unique(np.concatenate([g, *(h[0] for h in held)]))
            n = np.zeros(len(u), np.int64)
            for keys, times in ((g, c), *held):  # each without repeats
                n[np.searchsorted(u, keys)] += times
            held.clear()
            return u, n

        seen = _Seen()
        for b in batches:
            own = seen.add(b.column(0))
            known = np.isin(own, ids) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for i, j, texts in _texts(b.column(1)):
                grams, text, _ = _ngrams(texts)
                for trust in (True, False):
                    u, n = np.unique(grams[known[i:j][text] == trust], return_counts=True)
                    held.append((u, n if trust else np.zeros(len(u), np.int64)))
                if sum(len(h[0]) for h in held) > 1 << 20:
                    g, c = merge()
        seen.check(f"{trusted_root}/shape", part)
        g, c = merge()
        for i in range(0, len(g), 1 << 17):
            k = len(g[i:i + (1 << 17)])
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(g[i:i + k]), pa.array(c[i:i + k])],
                                             ["part", "g", "c"])

    return docs.mapInArrow(run, "part int, g long, c long")


def _suffix(g: Column, order: int) -> Column:
    return g.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams that occur once to four times."""
    n = [of.get(k, 0) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in zip((1, 2, 3), d))


def probabilities(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(g, logp) of every n-gram ``asked`` (g), from ``counts`` (g, c) of the
    highest order."""
    tables = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        tables[n] = saved(tables[n + 1].groupBy(_suffix(F.col("g"), n).alias("g")).agg(F.count(F.lit(1)).alias("c")),
                          f"order-{n}")
    wanted = {ORDER: asked}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select(_suffix(F.col("g"), n).alias("g")).distinct()
    lower = None
    for n in range(1, ORDER + 1):
        t = tables[n]
        of = {r["c"]: r["n"] for r in t.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        d1, d2, d3 = discounts(of)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.shiftrightunsigned("g", BITS)
        totals = (t.groupBy(context.alias("context"))
                  .agg(F.sum("c").alias("total"), (F.sum(cut) / F.sum("c")).alias("spared")))
        q = wanted[n].withColumn("context", context)
        q = q.join(t.select("g", ((F.col("c") - cut)).alias("mass")), "g", "left").join(totals, "context", "left")
        if n == 1:
            below = F.lit(1.0 / _SYMBOLS)
        else:
            q = q.withColumn("s", _suffix(F.col("g"), n - 1)).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
            below = F.col("below")
        own = F.coalesce(F.col("mass") / F.col("total"), F.lit(0.0))
        lower = q.select("g", (own + F.coalesce("spared", F.lit(1.0)) * below).alias("p"))
        if n < ORDER:
            lower = saved(lower, f"asked-{n}")
    return lower.select("g", F.log("p").alias("logp"))


def document_scores(docs: DataFrame, answers_root: str, shape_root: str) -> DataFrame:
    """(doc_id, lang, nll, n): the summed negative log probability and number
    of characters. ``docs``: doc_id, text, lang."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp = _load_side(answers_root, _part()) or [np.zeros(0, np.int64), np.zeros(0)]
        seen = _Seen()
        for b in batches:
            seen.add(b.column(0))
            nll, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for i, j, texts in _texts(b.column(1)):
                g, text, length = _ngrams(texts)
                if len(g):
                    at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
                    if not len(keys) or (keys[at] != g).any():
                        raise RuntimeError("a partition of the documents changed between two scans; "
                                           "score a table that is written down")
                    nll[i:j] = np.bincount(text, -logp[at], j - i)
                    count[i:j] = length
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nll), pa.array(count)],
                                             ["doc_id", "lang", "nll", "n"])
        seen.check(shape_root, _part())

    return docs.mapInArrow(run, "doc_id long, lang string, nll double, n long")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, lang, n_symbols, perplexity (per
    character, drawn towards the language's mean for short texts), bound (of
    its language) and keep.

    Trusted are the documents with quality 1 in ``labels`` (doc_id, quality; a
    null is no label). Toxicity is another question: text of good quality may
    be toxic and is kept here. Null, empty
    and blank texts have no symbols and are rejected as empty. Null is a
    language of its own. A language with fewer than LEAST_HELD_OUT held-out
    documents uses their bound or that of all judged languages, whichever is
    higher; with fewer than LEAST_TO_JUDGE, none among them, its bound is null
    and every non-empty text of it is kept.
    Repeated ids are scored row by row; null ids are never trusted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang"))
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    trusted_root, answers_root = scratch_path(spark, "trusted"), scratch_path(spark, "answers")
    rows = stable(rows)
    narrow = saved(rows.select("doc_id", F.spark_partition_id().alias("part")), "partition-ids")
    shape = narrow.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.coalesce("doc_id", F.lit(-1))).alias("bits"))
    _save_side(shape, f"{trusted_root}/shape", ["n", "bits"])
    trained = good.filter(~_held_out(F.col("_good")))
    _save_side(narrow.join(trained, narrow["doc_id"] == trained["_good"]).select("part", "doc_id").distinct(),
               trusted_root, ["doc_id"])

    found = saved(ngram_counts(rows.select("doc_id", "text"), trusted_root), "partition-ngrams")
    counts = saved(found.filter("c > 0").groupBy("g").agg(F.sum("c").alias("c")), "ngrams")
    answers = saved(probabilities(counts, found.select("g").distinct()), "log-probabilities")
    _save_side(found.select("part", "g").join(answers, "g"), answers_root, ["g", "logp"])

    scores = saved(document_scores(rows, answers_root, f"{trusted_root}/shape"), "scores")
    return _judged(scores, good)


def _held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("held out")), F.lit(HELD_OUT)) == 0


def _judged(scores: DataFrame, good: DataFrame) -> DataFrame:
    """Perplexity, bound and keep of scored documents. A row per language is
    joined to them; none is collected."""
    # Null is a language of its own.
    scores = scores.withColumn("l", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")))
    held = good.filter(_held_out(F.col("_good")))
    sample = scores.join(held, scores["doc_id"] == held["_good"], "left_semi").filter("n > 0").select("l", "nll", "n")
    mean = F.sum("nll") / F.sum("n")
    whole = sample.agg(mean).first()[0]
    per = sample.groupBy("l").agg(mean.alias("mean"), F.count(F.lit(1)).alias("docs"))
    # The mean that texts are drawn towards: the language's, if enough tell it.
    per = pinned(per.select("l", "docs", F.when(F.col("docs") >= LEAST_HELD_OUT, F.col("mean")).otherwise(whole).alias("towards")))
    # A language may hold a third of all rows: they are not dealt by it, but
    # for a corpus of more languages than a small broadcast holds.
    few = per.count() <= BROADCAST_LANGUAGES
    side = F.broadcast if few else lambda df: df
    drawn = (F.col("nll") + PRIOR * F.col("towards")) / (F.col("n") + PRIOR)
    marks = F.percentile_approx(drawn, [0.5, QUANTILE], 10_000)
    above = lambda q: q[0] + SLACK * (q[1] - q[0])
    sample = sample.join(side(per.filter(F.col("docs") >= LEAST_TO_JUDGE)), "l")
    pooled = sample.agg(marks.alias("q")).select(above(F.col("q"))).first()[0]
    edge = sample.groupBy("l").agg(marks.alias("q")).select("l", above(F.col("q")).alias("edge"))
    rule = per.join(edge, "l", "left").select("l", "towards", F.when(F.col("docs") >= LEAST_HELD_OUT, F.col("edge")).otherwise(
        F.when(F.col("edge").isNotNull(), F.greatest("edge", F.lit(pooled)))).alias("bound"))
    own = F.col("nll") / F.greatest("n", F.lit(1))
    towards = F.coalesce("towards", F.lit(whole).cast("double"))
    score = F.coalesce((F.col("nll") + PRIOR * towards) / (F.col("n") + PRIOR), own)
    bound = F.col("bound")
    return scores.join(side(rule), "l", "left").select(
        "doc_id", "lang", F.col("n").alias("n_symbols"), F.exp(score).alias("perplexity"), F.exp(bound).alias("bound"),
        ((F.col("n") > 0) & (bound.isNull() | (score <= bound))).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    rows, key = unique_ids(docs, id_col)
    if key != id_col:
        pairs = rows.select(F.col(key).alias("_row"), F.col(id_col).alias("_id"))
        labels = (labels.join(pairs, labels["doc_id"] == pairs["_id"]).drop("doc_id")
                  .withColumnRenamed("_row", "doc_id"))
    bad = quality_scores(rows, labels, key).filter("not keep").select("doc_id")
    return without(rows, bad, key).select(docs.columns)
