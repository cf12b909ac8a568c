"""A toxicity classifier that is regularised by counterfactuals, from Spark ML parts.

Features are which words a text has; the model is a logistic regression with an L1 penalty, so that words without evidence weigh
nothing and long texts do not add up noise. Counterfactual term: names of groups are put into labelled texts, one into each, chosen by the
text's hash, so that every name is met with either label whatever the corpus says of it; and wherever a labelled sentence names a
group, by itself or so, the name is swapped for each other name of its kind, and the change of the score is penalised. As the model is linear in the words, the
change is the difference of two weights whatever the rest of the sentence, so swaps enter the fit as rows whose only
features are -1 for the old and +1 for the new name, once with either label: their joint loss is log cosh of half the change, up to
a constant. They share a word that no text has, whose weight undoes the intercept for them. Names of groups thus get equal
weights, and a neutral mention does not read as an insult.

Most words have weight zero at the optimum. The fit takes names and those words that the labels pull from zero by half the penalty or
more. Then the pull on all other words is summed; while one is over the penalty, such words are added and the fit is made again.
So the model is that of all words, but the vectors that each round makes on the driver have only the words that matter.

A null or empty text scores by the intercept. Labels that are null are left out; a document with several labels counts once for
each. Where the labels have only one class the score is their mean, and 0 where there is none. Texts of any length are scored whole,
repeated documents alike, and an empty table gives no rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtable.llm.common import stage

#: Labelled documents that the fit uses at most, about: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: Words that occur in fewer of them are no features; of the others, the most frequent.
MIN_DOCUMENTS, VOCABULARY = 3, 1 << 16
PENALTY, ROUNDS = 2e-5, 60
#: Tasks of a round of the fit. The sample is bounded; so few partial sums go straight to the driver, without a stage that adds them up first.
FIT_TASKS = 4
#: Weight of a swap against that of a document, and of each pair of names without any sentence.
SWAP_WEIGHT, SWAP_PRIOR = 1.0, 1.0
#: Weight of a text with a name put in against that of the text itself.
NAMED_WEIGHT = 0.5
#: Part of the penalty from which on a pull brings a word into the fit.
NEAR = 0.5
THRESHOLD = 0.5
#: Names of groups in English, German, French and Spanish, by kind; names are swapped within a kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("man", "woman", "male", "female", "transgender", "nonbinary"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("american", "chinese", "indian", "mexican", "german", "french", "spanish", "russian", "turkish"),
    ("blind", "deaf", "disabled", "paralyzed", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("christ", "muslim", "jude", "hindu", "buddhist", "atheist"),
    ("amerikaner", "chinese", "inder", "türke", "russe", "franzose", "deutscher"),
    ("schwul", "lesbisch", "hetero"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("américain", "chinois", "indien", "turc", "russe", "français", "allemand"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("americano", "chino", "indio", "turco", "ruso", "francés", "alemán"),
    ("homme", "femme"), ("hombre", "mujer"), ("mann", "frau"),
)
WORDS, VECTOR, RAW, PROBABILITY, GUESS, ROW, TEXT = "words", "vector", "raw", "probability", "guess", "row", "text"
#: The word that only swaps have.
SWAP = "\x01"


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label and weight of the sample: some SAMPLE_ROWS rows, whatever repeats in either table. Its ids are broadcast, by the bound; texts stay where they are."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("double").alias("label")).where("label is not null and doc_id is not null")
    known = known.where(~is_held_out()).groupBy("doc_id", "label").agg(F.count("*").cast("double").alias("weight"))
    known = stage(known, "tox-labels")
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, SAMPLE_ROWS / max(n, 1))))
    chosen = known.where(part(known.count(), "doc_id"))
    found = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    n = found.count()
    if n > 1.2 * SAMPLE_ROWS:  # ids repeat in documents
        found = found.where(part(n, "text", F.monotonically_increasing_id()))
    return found.select("text", "label", "weight")


def with_names(tokens: DataFrame, kinds: Sequence[Sequence[str]]) -> DataFrame:
    """tokens (label, weight, words), and each again with one of the names among its words."""
    names = list(dict.fromkeys(t for kind in kinds for t in kind))
    if not names:
        return tokens
    name = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64(WORDS, F.lit("name")), F.lit(len(names))) + 1).cast("int"))
    put = tokens.withColumns({WORDS: F.array_append(WORDS, name), "weight": F.col("weight") * NAMED_WEIGHT})
    return tokens.unionByName(put)


def swaps_of(named: DataFrame, kinds: Sequence[Sequence[str]]) -> list[tuple[str, str, float]]:
    """(old, new, weight) of every ordered pair of names of a kind. named (label, weight, words): a swap weighs as much as the rows with its old name."""
    names = [t for kind in kinds for t in kind]
    met = named.select("weight", F.explode(F.array_intersect(WORDS, F.array(*map(F.lit, names)))).alias("w")).groupBy("w").agg(F.sum("weight").alias("n")).collect() if names else []
    count = {r["w"]: r["n"] for r in met}
    return [(old, new, SWAP_WEIGHT * (count.get(old, 0) + SWAP_PRIOR)) for kind in kinds for old, new in permutations(kind, 2)]


def swap_rows(swaps: Sequence[tuple[str, str, float]], vocabulary: CountVectorizerModel) -> list[tuple]:
    """(vector, label, weight) of the swaps, each with either label."""
    at = {w: i for i, w in enumerate(vocabulary.vocabulary)}
    return [(Vectors.sparse(len(at), {at[old]: -1.0, at[new]: 1.0, at[SWAP]: 1.0}), label, weight) for old, new, weight in swaps for label in (0.0, 1.0)]


def pulled(rows: DataFrame, least: float) -> dict[str, float]:
    """How much the rows (words, label, weight, score) pull words from weight zero, where that is at least so much: the size of the loss's derivative."""
    each = rows.select((F.col("weight") * (F.col("score") - F.col("label"))).alias("x"), F.explode(WORDS).alias("w"))
    return {r["w"]: r["pull"] for r in each.groupBy("w").agg(F.abs(F.sum("x")).alias("pull")).where(F.col("pull") >= least).collect()}


class Model:
    """Scores texts: an intercept and a weight for each word of the vocabulary, or one score for all."""

    def __init__(self, vocabulary: CountVectorizerModel | None, regression: LogisticRegressionModel | None, constant: float = 0.0) -> None:
        self.vocabulary, self.regression, self.constant = vocabulary, regression, constant

    def score(self, documents: DataFrame, text: str, score: str) -> DataFrame:
        """documents with a column score between 0 and 1."""
        kept = [F.col(f"{ROW}.`{c}`") for c in documents.columns if c != score]
        rows = documents.select(F.struct("*").alias(ROW), F.col(text).alias(TEXT))
        if self.vocabulary is None:
            return rows.select(*kept, F.lit(self.constant).alias(score))
        counted = self.vocabulary.transform(rows.withColumn(WORDS, words_of(TEXT))).drop(WORDS)
        return self.regression.transform(counted).select(*kept, vector_to_array(PROBABILITY)[1].alias(score))

    def weights(self) -> dict[str, float]:
        return {w: x for w, x in zip(self.vocabulary.vocabulary, self.regression.coefficients.toArray(), strict=True) if x}


def fit(train: DataFrame, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """A model from rows (text, label, weight)."""
    train = stage(train, "tox-train")
    ends = train.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if ends[1] == ends[2]:
        return Model(None, None, float(ends[0] or 0.0))
    tokens = stage(train.select("label", "weight", F.array_distinct(words_of("text")).alias(WORDS)), "tox-tokens")
    found = CountVectorizer(inputCol=WORDS, outputCol=VECTOR, minDF=MIN_DOCUMENTS, vocabSize=VOCABULARY, binary=True).fit(tokens).vocabulary
    names = list(dict.fromkeys(t for kind in kinds for t in kind))
    named, model = with_names(tokens, kinds), None
    swaps = swaps_of(named, kinds)
    weight, toxic = named.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("label"))).first()
    penalty = PENALTY * (weight + sum(2 * n for *_, n in swaps))
    scored, out, chosen = named.withColumn("score", F.lit(toxic / weight)), set(found) - set(names), set()
    while True:
        pull = pulled(scored, NEAR * penalty)
        near = out & pull.keys()
        if model and all(pull[w] <= penalty for w in near):
            return model
        out, chosen = out - near, chosen | near
        vocabulary = CountVectorizerModel.from_vocabulary([*names, *(w for w in found if w in chosen), SWAP], inputCol=WORDS, outputCol=VECTOR).setBinary(True)
        counted = vocabulary.transform(named)
        model = Model(vocabulary, regression(counted, swap_rows(swaps, vocabulary)))
        scored = model.regression.transform(counted).select(WORDS, "label", "weight", vector_to_array(PROBABILITY)[1].alias("score"))


def regression(counted: DataFrame, swaps: list[tuple]) -> LogisticRegressionModel:
    """Of rows (vector, label, weight) and those of the swaps."""
    vectors = counted.select(VECTOR, "label", "weight")
    if swaps:
        schema = T.StructType([T.StructField(VECTOR, VectorUDT()), T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType())])
        vectors = vectors.unionByName(counted.sparkSession.createDataFrame(swaps, schema))
    return LogisticRegression(
        featuresCol=VECTOR, labelCol="label", weightCol="weight", rawPredictionCol=RAW, probabilityCol=PROBABILITY, predictionCol=GUESS,
        standardization=False, regParam=PENALTY, elasticNetParam=1.0, maxIter=ROUNDS,
    ).fit(vectors.coalesce(FIT_TASKS))


def mention_rate(model: Model, documents: DataFrame, kinds: Sequence[Sequence[str]] = IDENTITY_TERMS) -> float:
    """Part of the clean documents (text) that a name of a group put into them makes toxic, over all names: false positives on neutral mentions."""
    clean = model.score(documents.select("text"), "text", "before").where(F.col("before") < THRESHOLD)
    names = F.array(*[F.lit(t) for kind in kinds for t in kind])
    named = clean.select("text", F.explode(names).alias("name")).select(F.concat_ws(" ", "text", "name").alias("text"))
    told = model.score(named, "text", "after")
    return told.agg(F.avg((F.col("after") >= THRESHOLD).cast("double"))).first()[0] or 0.0
