"""Problem 10: natural prose told from lists, tables and junk.

Thresholds on a body's statistics are taken as noisy labelling functions.  How far each can be trusted is learned
without labels, by expectation-maximization on their agreements: every text type has its own distribution over the votes
of each function.  The posterior of the four types (prose, list, table, junk) alone decides.  All the corpus enters as
counts of vote patterns, whose number is bounded by the functions' possible votes, so what reaches the driver doesn't
grow with the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import bodies
from corvina.llm.analysis import common_words
from corvina.session import ship

#: Rounds of expectation-maximization; it ends early when the posteriors stand still.
ROUNDS = 60

#: The text types, by the votes that name them.
TYPES = {"P": "prose", "L": "list", "T": "table", "J": "junk"}

#: Weight of the prior distribution of every function's votes, in documents.
PRIOR = 20.0

# A vote's chance at the start: for the function's own type, for another type that isn't prose (where the type is none
# either), for a type it speaks against.
_OWN, _NEAR, _AGAINST = 0.5, 0.2, 0.04
_VOTE = "PNLTJ0"


def _start(kind: str) -> dict[str, float]:
    """Distribution of a function's votes on texts of a type, before anything is learned."""
    raw = {}
    for v in _VOTE:
        if v == "0":
            raw[v] = 0.3
        elif v == kind or v == "N" and kind != "P":
            raw[v] = _OWN
        elif kind == "P" or v == "P":
            raw[v] = _AGAINST
        else:
            raw[v] = _NEAR
    whole = sum(raw.values())
    return {v: x / whole for v, x in raw.items()}


def fit(patterns: dict[str, int]) -> dict[str, dict[str, float]]:
    """Posterior of the text types (by their letter) for every vote pattern, from the number of documents with it.

    The functions are independent given the type.  The distributions at the start name the types and stay as a prior.
    """
    size = len(next(iter(patterns), ""))
    start = {t: _start(t) for t in TYPES}
    table = {t: [dict(start[t]) for _ in range(size)] for t in TYPES}
    share = {t: 0.7 if t == "P" else 0.1 for t in TYPES}
    total = sum(patterns.values())
    posterior: dict[str, dict[str, float]] = {}
    for _ in range(ROUNDS):
        moved = 0.0
        logs = {t: [{v: math.log(x) for v, x in f.items()} for f in table[t]] for t in TYPES}
        for pattern in patterns:
            weight = {t: math.log(share[t]) + sum([f[v] for f, v in zip(logs[t], pattern)]) for t in TYPES}
            top = max(weight.values())
            raw = {t: math.exp(w - top) for t, w in weight.items()}
            whole = sum(raw.values())
            new = {t: x / whole for t, x in raw.items()}
            moved = max(moved, abs(new["P"] - posterior[pattern]["P"]) if pattern in posterior else 1.0)
            posterior[pattern] = new
        for t in TYPES:
            share[t] = (sum([n * posterior[p][t] for p, n in patterns.items()]) + PRIOR / len(TYPES)) / (total + PRIOR)
            for i in range(size):
                count = {v: PRIOR * x for v, x in start[t].items()}
                for pattern, n in patterns.items():
                    count[pattern[i]] += n * posterior[pattern][t]
                whole = sum(count.values())
                table[t][i] = {v: c / whole for v, c in count.items()}
        if moved < 1e-6:
            break
    return posterior


def posteriors(analysed: DataFrame) -> DataFrame:
    """``analysed`` with ``prose``, ``list``, ``table`` and ``junk``, the posterior of each text type, and ``text_type``, the likeliest.

    All null for an empty body.  ``text_type`` is ``prose`` only where that is likelier than the others together.
    """
    # Bounded by the functions' possible votes: at most 4 * 3 ** 6 * 4 rows.
    counted = analysed.where("body_chars > 0 AND NOT residue").groupBy("votes").agg(F.count("*").alias("n")).collect()
    learned = fit({row.votes: row.n for row in counted})
    spark = analysed.sparkSession
    names = list(TYPES.values())
    rows = [(k, *[float(p[t]) for t in TYPES], "prose" if p["P"] >= 0.5 else TYPES[max("LTJ", key=p.get)]) for k, p in learned.items()]
    known = spark.createDataFrame(rows, "votes string, " + ", ".join(f"{n} double" for n in names) + ", text_type string")
    out = analysed.join(F.broadcast(known), "votes", "left")
    return out.withColumns({n: F.when(F.col("body_chars") > 0, F.col(n)) for n in [*names, "text_type"]})


_STATS = "doc_id long, words long, mean_word_length double, symbol_ratio double, ended_lines double, common_share double"


def text_statistics(documents: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, words, mean_word_length, symbol_ratio, ended_lines, common_share) of every text; nulls for a null text, zeros for one without words."""
    ship(documents.sparkSession)
    common = common_words(words)
    names = [x.strip().split(" ")[0] for x in _STATS.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows = [(None,) * 5 if t is None else bodies.statistics(t, common) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.float64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _STATS)
