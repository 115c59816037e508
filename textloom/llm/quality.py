"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad labelled text. A text is cut
into blocks, each block is compressed with either dictionary, and the sizes are summed over the whole
text: (bad - good) / (bad + good) is positive where good text explains it better. A logistic curve,
fitted on labelled documents that the dictionaries have not seen, turns that into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import q, with_text

LEVEL = 3
PRIOR = 200


class Model:
    """Dictionaries and the calibration; ``probability`` is that of good quality."""

    def __init__(self, good: bytes, bad: bytes, block: int) -> None:
        self.good, self.bad, self.block = good, bad, block
        self.slope = self.offset = self.threshold = 0.0

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress
            )
        return out

    def difference(self, text: bytes, good, bad) -> float:
        a = b = 0
        for i in range(0, len(text), self.block):
            part = text[i : i + self.block]
            a += len(good(part))
            b += len(bad(part))
        return (b - a) / (b + a + PRIOR)

    def probability(self, difference):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(difference) + self.offset, -50, 50)))


def dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    """A zstandard dictionary from blocks of the texts; few or tiny texts are used as they are."""
    samples = [t[i : i + block] for t in texts for i in range(0, len(t), block)]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b"\n".join(samples) or b"empty dictionary")[-size:].ljust(16)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Platt's slope and offset with his smoothed targets, by Newton's method on scaled input."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(x).max(initial=0)), 1e-9)
    design = np.stack([x / scale, np.ones(len(x))], 1)
    weight = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weight, -50, 50)))
        gradient = design.T @ (p - target) + ridge * weight
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weight -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(weight[0] / scale), float(weight[1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    max_labelled: int = 1500,
    dictionary_bytes: int = 64 << 10,
    block: int = 2048,
    max_loss: float = 0.005,
    max_bytes: int = 1 << 16,
) -> Model:
    """Fit on at most ``max_labelled`` labelled documents of each class, those with the least id hash.

    Two thirds build the dictionaries, one third the calibration. Labels other than 0 and 1, null ids
    and null texts are left out, and of several labels or texts for an id the least one counts; so are texts of
    more than ``max_bytes`` bytes, whole, so that the sample fits the driver. Documents that ``labels`` call toxic,
    if it has such a column, are no examples of good text. Other columns of either table are ignored, whatever
    their names. Without labels of both classes the model knows nothing and gives 0.5 to all.
    """
    known = {c.lower(): c for c in labels.columns}
    toxic = F.coalesce(F.col(q(known["toxic"])) == 1, F.lit(False)) if "toxic" in known else F.lit(False)
    clean = labels.select(F.col(q(id_col)).alias("lid"), F.col(q("quality")).alias("quality"), toxic.alias("toxic"))
    clean = clean.where(F.col("quality").isin(0, 1) & F.col("lid").isNotNull())
    clean = clean.groupBy("lid").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 0 or not toxic")
    chosen = None
    for v in (0, 1):
        part = clean.where(F.col("quality") == v).orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
        chosen = part if chosen is None else chosen.unionByName(part)
    named = docs.select(F.col(q(id_col)).alias("did"), F.col(q(text_col)).alias("text"))
    rows = (
        named.join(F.broadcast(chosen), F.col("did") == F.col("lid"))  # at most 2 * max_labelled rows
        .where(F.octet_length("text") <= max_bytes)
        .groupBy("lid", "quality")
        .agg(F.min("text").alias("text"))
        .select("lid", "quality", "text", F.xxhash64("lid", F.lit(1)).alias("h"))
        .collect()
    )
    rows.sort(key=lambda r: (r.h, str(r.lid)))
    sets: dict = {(v, part): [] for v in (0, 1) for part in (0, 1)}
    for v in (0, 1):
        for i, r in enumerate(r for r in rows if r.quality == v):
            sets[v, int(i % 3 == 2)].append(r.text.encode())
    if not all(sets[v, 0] for v in (0, 1)):
        return Model(b"empty dictionary", b"empty dictionary", block)
    model = Model(*(dictionary(sets[v, 0], dictionary_bytes, block) for v in (1, 0)), block)
    held = [(v, t) for v in (0, 1) for t in (sets[v, 1] or sets[v, 0])]
    good, bad = model.compressors()
    x = np.array([model.difference(t, good, bad) for _, t in held])
    y = np.array([v for v, _ in held], float)
    model.slope, model.offset = fit_logistic(x, y)
    model.threshold = min(0.5, float(np.quantile(model.probability(x[y == 1]), max_loss)))
    return model


def quality_scores(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score", keep_col: str = "keep"
) -> DataFrame:
    """``docs`` with the probability that each text is good, and whether to keep it.

    Null and empty texts have difference 0 and so the score of a text that neither side explains.
    Columns of the input named like the new ones are replaced, all others pass through; equal texts get
    equal scores.
    """
    taken = {score_col.lower(), keep_col.lower()}
    cols = [c for c in docs.columns if c.lower() not in taken]
    schema = docs.select(*[F.col(q(c)) for c in cols]).schema.add(score_col, "double").add(keep_col, "boolean")

    def score(batches):
        good, bad = model.compressors()
        for batch in batches:
            texts = batch.column(place).cast(pa.large_binary())
            d = np.array([model.difference(t.as_py() or b"", good, bad) for t in texts], float)
            p = model.probability(d)
            arrays = batch.columns[: len(cols)] + [pa.array(p, pa.float64()), pa.array(p >= model.threshold)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*cols, score_col, keep_col])

    staged, place = with_text(docs, cols, text_col)
    return staged.mapInArrow(score, schema)
