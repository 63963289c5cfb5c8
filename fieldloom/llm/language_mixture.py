"""Language ID as mixture inference.

A model holds, for every learned language, smoothed log-probabilities of hashed byte trigrams of lower-cased text.  Each word
of a document has a likelihood under each language; expectation-maximisation finds the document's language proportions, first
over all languages, then over the leading one, two, three, ...  The set grows as long as the penalised likelihood gets better
(half a log of the number of words for each further language), up to all languages; the prediction is its largest proportion.

The model is fitted on a bounded sample of labelled rows (TRAIN_DOCS, picked by a hash of the id) and has
TRIGRAMS numbers a language, the one thing that is broadcast.

Cases: a null text, or one without letters, is `und` with score 0; so is everything if nothing could be learned; very long
texts are worked on in one piece, batches in runs of RUN_CHARS; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common, tokens

TRAIN_DOCS = 20_000
TRIGRAM_BITS = 15
TRIGRAMS = 1 << TRIGRAM_BITS
ROUNDS, TOLERANCE, SMOOTHING = 200, 1e-3, 0.1
RUN_CHARS = 500_000
LETTER = re.compile(r"[^\W\d_]")


def trigrams(texts: list[str]):
    """(bucket of the trigram that ends at each byte, first byte of each word, words of each text)."""
    import numpy as np

    data = [b"  " + (t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    raw = np.frombuffer(b"".join(data), "u1").astype("u4")
    code = np.zeros(len(raw), "u4")
    code[2:] = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - TRIGRAM_BITS)
    gap = raw <= 32
    bucket[1:][gap[1:] & gap[:-1]] = TRIGRAMS  # a blank after a blank counts for nothing, so that a text's place in a batch doesn't either
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    ends = np.cumsum([len(d) for d in data])
    return bucket, starts, np.diff(np.r_[0, np.searchsorted(starts, ends)])


def _count(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    total: dict[str, object] = {}
    for rows in tokens.runs(batches, most=RUN_CHARS):
        langs = rows.column("lang").to_pylist()
        texts = rows.column("text").to_pylist()
        for lang in set(langs):
            bucket, _, _ = trigrams([t for t, x in zip(texts, langs) if x == lang])
            total[lang] = total.get(lang, 0) + np.bincount(bucket, minlength=TRIGRAMS + 1)[:TRIGRAMS]
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype("i4")), pa.array(n[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, bound: int = TRAIN_DOCS) -> tuple[list[str], object]:
    """labelled (doc_id, text, lang) -> (languages, log-probabilities [TRIGRAMS, languages])."""
    import numpy as np

    sample = common.bounded_sample(labelled, "doc_id", bound).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # TRIGRAMS rows a language at most
    langs = sorted(counts["lang"].unique())
    n = np.full((TRIGRAMS, len(langs)), SMOOTHING)
    n[counts["bucket"].to_numpy(), [langs.index(x) for x in counts["lang"]]] += counts["n"].to_numpy()
    return langs, np.log(n / n.sum(axis=0)).astype("f4")


def mixtures(texts: list[str], table):
    """Proportions [texts, languages] of the selected language sets; zeros outside a text's set."""
    import numpy as np

    bucket, starts, n_words = trigrams(texts)
    d, k = len(texts), table.shape[1]
    out = np.zeros((d, k), "f4")
    full = np.flatnonzero(n_words)
    if not len(full):
        return out
    table = np.vstack([table, np.zeros((1, k), table.dtype)])
    like = np.add.reduceat(table[bucket], starts, axis=0)
    top = like.max(axis=1)
    like = np.exp(like - top[:, None])
    n = n_words[full]
    owner = np.repeat(np.arange(len(full)), n)
    share, _ = em(like, n, np.ones((len(full), k), "f4"))
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    best, value = np.zeros((len(full), k), "f4"), np.full(len(full), np.inf)
    live = np.arange(len(full))
    for size in range(1, k + 1):
        rows = like if len(live) == len(full) else like[np.isin(owner, live)]
        share, fit = em(rows, n[live], (rank[live] < size).astype("f4"))
        cost = -fit + (size - 1) * 0.5 * np.log(n[live] + 1.0)
        better = cost < value[live]
        live = live[better]
        best[live], value[live] = share[better], cost[better]
        if not len(live):
            break
    out[full] = best
    return out


def em(like, n, open_):
    """Proportions [texts, languages] and log-likelihoods; like has a row for each word, n the number of words of each text.

    open_ says which languages a text may have.  Each text goes on until none of its proportions moves by TOLERANCE, or for
    ROUNDS rounds, whatever texts are beside it.
    """
    import numpy as np

    tiny = np.float32(1e-30)
    share = open_ / open_.sum(axis=1, keepdims=True)
    live, rows, left = np.arange(len(n)), like, n
    for _ in range(ROUNDS if open_.shape[1] > 1 else 0):
        r = rows * np.repeat(share[live], left, axis=0)
        r /= r.sum(axis=1, keepdims=True) + tiny
        new = np.add.reduceat(r, np.r_[0, np.cumsum(left)[:-1]], axis=0) / left[:, None].astype("f4")
        moved = np.abs(new - share[live]).max(axis=1) >= TOLERANCE
        share[live] = new
        if not moved.any():
            break
        if not moved.all():
            rows, live, left = rows[np.repeat(moved, left)], live[moved], left[moved]
    fit = np.add.reduceat(np.log((like * np.repeat(share, n, axis=0)).sum(axis=1) + tiny), np.r_[0, np.cumsum(n)[:-1]])
    return share, fit


def _predict(model):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        langs, table = model.value
        for rows in tokens.runs(batches, most=RUN_CHARS):
            texts = rows.column("text").to_pylist()
            know = np.array([bool(langs) and LETTER.search(t or "") is not None for t in texts])
            if langs:
                share = mixtures(texts, table)
                pick = share.argmax(axis=1)
                score = np.where(know, np.minimum(share.max(axis=1), 1), 0)
                pred = [langs[i] if ok else "und" for i, ok in zip(pick, know)]
                mix = [" ".join(f"{langs[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] >= 0.0005) if ok else "" for s, ok in zip(share, know)]
            else:
                score, pred, mix = np.zeros(len(texts)), ["und"] * len(texts), [""] * len(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.round(score.astype("f8"), 6)), pa.array(mix, pa.string())], ["doc_id", "lang_pred", "score", "mixture"])

    return run


def predict(df: DataFrame, langs: list[str], table) -> DataFrame:
    """df (doc_id, text) -> (doc_id, lang_pred, score, mixture)."""
    model = df.sparkSession.sparkContext.broadcast((langs, table))
    return df.select("doc_id", "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, mixture string")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    seen = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found = predict(docs, *fit(seen.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
