"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin
from .common import hold, id_class, map_texts, run_starts

#: Labelled documents learnt from (an expected number, picked by a hash of the id), and lexicon entries.
SAMPLE_DOCS, LEXICON = 20_000, 4_000
#: A lexicon entry is in at least this many toxic texts, and that many times likelier in them.
LEAST_TEXTS, LEAST_RATIO = 5, 8.0
PREFIXES = (4, 5, 6)
NEAR = 3
REMEMBERED = 300_000
# Second-person words of English, French, German and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "deinen deiner ihr euch euer eure ti tú tus usted ustedes vosotros vuestro".split()
)
# Signs commonly written for letters.
_SIGNS = str.maketrans("013457@$!|+", "oieastasiit")
_LETTERS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"(.)\1{2,}")

FEATURES = (
    "words lexicon_words lexicon_density lexicon_weight weight_density strongest disguised "
    "near_second_person second_person capitals capital_words exclamation question other_punctuation "
    "digits mixed single_letters repeats"
).split()


def plain(token: str) -> str:
    """The letters of a token, lower-cased; empty if it has none."""
    return "".join(_LETTERS.findall(token)).lower()


def undisguised(token: str) -> str:
    """A token with signs read as letters, marks inside it left out and long runs shortened."""
    core = token.strip(".,;:!?\"'()[]{}*%&#$").lower().translate(_SIGNS)
    return _REPEATED.sub(r"\1", "".join(_LETTERS.findall(core)))


def grams(word: str) -> list[str]:
    """What a lexicon can hold of a word: the word, and its beginnings marked as such."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


class Tokens(dict):
    """Row numbers of tokens whose features are known; each new token is looked at once.

    Columns: 1, letters, capitals, all-capital, "!", "?", other marks, digits, mixed, single letter,
    repeated run, second person, weight, weight if disguised.
    """

    WIDTH = 14

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.rows = lexicon, []

    def _weight(self, word: str) -> float:
        get = self.lexicon.get
        return max((get(g, 0.0) for g in grams(word)), default=0.0) if word else 0.0

    def __missing__(self, token: str) -> int:
        word = plain(token)
        letters = sum(map(str.isalpha, token))
        upper = sum(map(str.isupper, token)) if letters else 0
        digits = sum(map(str.isdigit, token))
        bang, question = token.count("!"), token.count("?")
        inner = token.strip(".,;:!?\"'()[]{}*%&#$")
        mixed = bool(inner) and not inner.isalpha() and letters > 0
        weight = self._weight(word) if inner.isalpha() else 0.0
        hidden = 0.0
        if not weight and (mixed or _REPEATED.search(token)):
            hidden = max(self._weight(undisguised(token)), self._weight(word))
        self.rows.append(
            (
                1, letters, upper, letters > 1 and upper == letters, bang, question,
                len(token) - letters - digits - bang - question, digits, mixed, letters == 1 and len(inner) == 1,
                _REPEATED.search(token) is not None, word in SECOND_PERSON, weight or hidden, hidden,
            )
        )
        self[token] = number = len(self)
        return number


def _features(texts: list[str], tokens: Tokens, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    split = [t.split() for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    rows = np.fromiter((tokens[w] for s in split for w in s), np.int64, int(counts.sum()))
    if tokens.rows:
        table = np.concatenate([table, np.array(tokens.rows, np.float32)])
        tokens.rows = []
    sums, strongest, near = np.zeros((len(texts), Tokens.WIDTH)), np.zeros(len(texts)), np.zeros(len(texts))
    hits = np.zeros(len(texts))
    full = np.flatnonzero(counts)
    if len(rows):
        starts = run_starts(counts)
        for at in range(0, len(full), 256):  # a few texts at a time, so the looked-up rows stay few
            some = full[at : at + 256]
            part = rows[starts[some[0]] : starts[some[-1]] + counts[some[-1]]]
            found = table[part]
            cuts = starts[some] - starts[some[0]]
            sums[some] = np.add.reduceat(found, cuts, axis=0, dtype=np.float64)
            strongest[some] = np.maximum.reduceat(found[:, 12], cuts)
            hits[some] = np.add.reduceat(found[:, 12] > 0, cuts, dtype=np.int64)
            person = np.cumsum(np.concatenate([[0], found[:, 11] > 0]))
            place = np.flatnonzero(found[:, 12] > 0)
            if len(place):
                doc = np.searchsorted(cuts, place, "right") - 1
                first, end = cuts[doc], np.append(cuts[1:], len(part))[doc]
                low, high = np.maximum(place - NEAR, first), np.minimum(place + NEAR + 1, end)
                near[some] = np.bincount(doc[person[high] > person[low]], minlength=len(some))
    n, letters = np.maximum(sums[:, 0], 1), np.maximum(sums[:, 1], 1)
    chars = np.maximum(sums[:, 1] + sums[:, 4:8].sum(1), 1)
    dense = [
        np.log1p(sums[:, 0]), np.log1p(hits), hits / n, np.log1p(sums[:, 12]), sums[:, 12] / n, strongest,
        np.log1p((sums[:, 13])), np.log1p(near), sums[:, 11] / n, sums[:, 2] / letters, sums[:, 3] / n,
        sums[:, 4] / chars, sums[:, 5] / chars, sums[:, 6] / chars, sums[:, 7] / chars, sums[:, 8] / n,
        sums[:, 9] / n, sums[:, 10] / n,
    ]
    return np.stack(dense, axis=1), table


_WORKER: dict = {}


def _remembered(mark: int, lexicon: dict[str, float]) -> tuple[Tokens, np.ndarray]:
    """Tokens this worker process has looked at under a lexicon, and their features (see ``langid``)."""
    hold(_WORKER.clear)
    if mark not in _WORKER or len(_WORKER[mark][0]) > REMEMBERED:
        _remember(mark, Tokens(lexicon), np.zeros((0, Tokens.WIDTH), np.float32))
    return _WORKER[mark]


def _remember(mark: int, tokens: Tokens, table: np.ndarray) -> None:
    _WORKER.clear()
    _WORKER[mark] = tokens, table


def features(documents: DataFrame, lexicon: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``key`` and the dense features of every whole text; null and empty texts have zeros."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)
    mark = hash(tuple(sorted(lexicon.items())))

    def run(texts):
        tokens, table = _remembered(mark, shared.value)
        dense, table = _features([(t or b"").decode() for t in texts], tokens, table)
        _remember(mark, tokens, table)
        return [pa.array(np.ascontiguousarray(c)) for c in dense.T]

    return map_texts(documents, key, ", ".join(f"{f} double" for f in FEATURES), run)


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Words and word beginnings that mark toxic texts, with their log odds.

    ``labelled`` has text and label. Counts are of texts, added up per task before the shuffle; of
    entries likely enough the LEXICON best are kept, which bounds what the driver gets.
    """
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)

    def distinct(texts):
        found = []
        for text in texts:
            seen = {plain(t) for t in set((text or b"").decode().split())} - {""}
            found.append(sorted({g for w in seen for g in grams(w)}))
        return [pa.array(found, pa.list_(pa.string()))]

    per_text = map_texts(labelled, "label", "grams array<string>", distinct)
    counts = per_text.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1)))
    best = counts.where(F.col("t") >= LEAST_TEXTS).withColumn("w", odds).where(F.col("w") >= float(np.log(LEAST_RATIO)))
    return {r["gram"]: float(r["w"]) for r in best.orderBy(F.desc(F.col("w") * F.sqrt("t")), "gram").limit(LEXICON).collect()}


def _vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(df)


def score(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", folds: int = 4, held_fold: int = 2, sample_docs: int = SAMPLE_DOCS
) -> DataFrame:
    """``key``, held_out and score (0 to 1) of every whole text.

    Labels (``key``, toxic) teach only where crc32 of the id as text, modulo ``folds``, is not
    ``held_fold``. Of these about ``sample_docs`` documents, picked by a hash of the id, are
    learnt from: one half gives the lexicon and the trees, the other the calibration and, with the
    lexicon known, part of nothing else, so neither sees its own words. With labels of one kind
    only, or none, every score is the share of toxic labels, 0 without any.

    A document is scored in the task that reads it: features from a worker's table of tokens, trees
    and calibration as expressions of the plan. Null texts are empty, and empty texts are scored
    like any other. A null id is not held out and does not teach; rows are all kept, repeated ones
    too; several labels of one id count as the largest, null labels not at all.
    """
    documents = documents.select(key, F.col("text").cast("string").alias("text"))  # no other name of theirs matters here
    fold = id_class(key, folds)
    held_out = F.coalesce(fold == held_fold, F.lit(False))
    taught = labels.where((fold != held_fold) & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("label"))
    place = F.pmod(F.xxhash64(F.lit("toxic"), F.col(key)), F.lit(1 << 30))
    share = min(1.0, sample_docs / max(1, taught.count()))
    picked = taught.where(place < int(share * (1 << 30))).withColumnRenamed(key, "_id")
    sample = documents.join(picked, F.col(key) == F.col("_id")).where("text is not null")
    sample = pin(sample.select(key, "text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label")), "toxicity")
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        constant = kinds.get(1, 0) / max(1, sum(kinds.values()))
        return documents.select(key, held_out.alias("held_out"), F.lit(float(constant)).alias("score"))
    for_trees = F.pmod(F.xxhash64(F.lit("half"), F.col(key)), F.lit(2)) == 0
    if sample.where(for_trees).select("label").distinct().count() < 2 or sample.where(~for_trees).select("label").distinct().count() < 2:
        for_trees = F.lit(True)
    lexicon = learn_lexicon(sample.where(for_trees))
    known = features(sample.select(F.struct(key, "label").alias("row"), "text"), lexicon, "row")
    known = pin(known.select(F.col(f"row.{key}").alias(key), "row.label", *FEATURES).coalesce(2), "toxicity")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, seed=7)
    model = trees.fit(_vector(known.where(for_trees)))
    first = _probability(model, known)
    calibration = first.where(~for_trees)
    if calibration.isEmpty():
        calibration = first
    isotonic = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="score").fit(calibration)
    scored = isotonic.transform(_probability(model, features(documents, lexicon, key)))
    held_out = F.coalesce(id_class(key, folds) == held_fold, F.lit(False))
    return scored.select(key, held_out.alias("held_out"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _probability(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's probability of a toxic text in ``_p``."""
    scored = model.transform(_vector(df))
    p: Column = vector_to_array("probability")[1]
    return scored.withColumn("_p", p).drop("_features", "rawPrediction", "probability", "prediction")
