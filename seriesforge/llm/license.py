"""Licence scans: a trained paragraph classifier over word n-grams, in DataFrame expressions throughout.

Paragraphs are the lines of a text.  A multinomial logistic regression on the one- and two-word grams of a paragraph,
kept sparse by an L1 penalty, tells licence families and ``none`` apart.  It is fitted on windows of published licence
texts, on sentences that are no licence and on a sample of corpus lines taken by hash (about ``NEGATIVES`` lines, a
documented bound).  Logits are scaled by a temperature fitted on held-out windows, and a family is named only if its
probability passes a bound set on corpus lines of the sample; else a paragraph with licence evidence is ``unknown``.
Each named family is confirmed when the paragraph holds, or is held by, one of its templates to at least ``CONFIRM``
in shared two-word grams.

A line without any word of a feature has the score of ``none`` by construction and needs no further work.  Null and
empty texts have no paragraph of a licence; repeated rows are scanned each; columns of any name pass by unread.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from .license_texts import COMMON, FAMILIES, OTHER

NONE = "none"
NEGATIVES = 3000
WINDOW = 12                 # words of a training window
CONFIRM = 0.5
TEMPERATURES = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]


def words_of(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def _telling(gram: str) -> bool:
    return any(w not in COMMON and len(w) > 2 and not w.isdigit() for w in gram.split()) or gram in ("cc by", "by nc", "by sa", "by nd")


def anchors(grams: list[str]) -> list[str]:
    """Words of which every feature holds at least one."""
    return sorted({w for g in grams for w in g.split() if (w not in COMMON and len(w) > 2 and not w.isdigit()) or w in ("cc", "nc", "sa", "nd")})


class Model:
    """Weights and calibration; small by construction (the grams of the templates)."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], intercept: list[float]):
        self.classes, self.weights = classes, weights
        none = classes.index(NONE)
        gap = max(intercept) - intercept[none]
        self.intercept = [x + (gap if i == none else 0.0) for i, x in enumerate(intercept)]     # no evidence means none
        self.temperature, self.bound = 1.0, 0.5

    def score(self, df: DataFrame, temperature: float | None = None) -> DataFrame:
        """Add ``p``, the probabilities of the classes, from ``words``; each step is a column, so none runs twice."""
        t = self.temperature if temperature is None else temperature
        known = literal(sorted(self.weights))
        table = F.map_from_arrays(known, literal([self.weights[g] for g in sorted(self.weights)]))
        hits = F.array_intersect(F.concat("words", pairs_of(F.col("words"))), known)
        df = settled(df, "_w", F.transform(hits, lambda g: F.element_at(table, g)))
        start = literal(self.intercept)
        df = settled(df, "_l", F.aggregate("_w", start, lambda a, w: F.zip_with(a, w, lambda x, y: x + y)))
        df = settled(df, "_top", F.array_max("_l"))
        df = settled(df, "_e", F.transform("_l", lambda x: F.exp((x - F.col("_top")) / F.lit(t))))
        df = settled(df, "_sum", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        return settled(df, "p", F.transform("_e", lambda x: x / F.col("_sum"))).drop("_w", "_l", "_top", "_e", "_sum")


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters and lambdas read but do not compute again: no expression moves through a
    generator."""
    return df.withColumn(name, F.explode(F.array(value)))


def literal(x) -> Column:
    """Nested lists of strings or numbers as one constant."""
    def sql(v) -> str:
        if isinstance(v, list):
            return "array(" + ",".join(map(sql, v)) + ")"
        return "'" + v.replace("'", "") + "'" if isinstance(v, str) else f"{float(v)!r}D"
    return F.expr(sql(x))


def _examples(spark: SparkSession, docs: DataFrame, text: str) -> DataFrame:
    """label, words, held: training windows; every fifth is held out for calibration."""
    rows = []
    for family, texts in [*FAMILIES.items(), (NONE, OTHER)]:
        for t in texts:
            w = [x for x in "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split() if x]
            rows.append((family, w))
            if family != NONE:
                rows += [(family, w[i:i + WINDOW]) for i in range(0, len(w) - WINDOW, WINDOW // 3)]
    made = spark.createDataFrame(rows, "label string, words array<string>")
    n = docs.select(F.sum(F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")))).first()[0] or 0
    share = min(1.0, NEGATIVES / n) if n else 0.0
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("line")).where(F.pmod(F.xxhash64("line", F.rand(17)), F.lit(2**30)) < F.lit(share) * 2**30)
    seen = literal(sorted({" ".join(w[i:i + 2]) for f, w in rows if f != NONE for i in range(len(w) - 1) if _telling(" ".join(w[i:i + 2]))}))
    quiet = lines.select(words_of(F.col("line")).alias("words")).where(~F.arrays_overlap(pairs_of(F.col("words")), seen) & (F.size("words") > 0))
    corpus = quiet.select(F.lit(NONE).alias("label"), "words")
    both = made.withColumn("corpus", F.lit(False)).unionByName(corpus.withColumn("corpus", F.lit(True)))
    return saved(both.withColumn("held", F.pmod(F.xxhash64("words"), F.lit(5)) == 0))


def train(docs: DataFrame, text: str = "text") -> Model:
    spark = docs.sparkSession
    examples = _examples(spark, docs, text)
    classes = [NONE, *sorted(FAMILIES)]
    grams = examples.where("not corpus").select(F.explode(F.array_distinct(F.concat("words", pairs_of(F.col("words"))))).alias("g")).distinct().toPandas().g.tolist()
    keep = sorted(g for g in grams if _telling(g))          # bounded by the templates
    known = literal(keep)
    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    rows = saved(examples.select("held", "corpus", "words", number[F.col("label")].alias("label"),
                                 F.array_intersect(F.concat("words", pairs_of(F.col("words"))), known).alias("hits")))
    counter = CountVectorizer(inputCol="hits", outputCol="features", vocabSize=len(keep), minDF=1.0, binary=True).fit(rows.where("not corpus"))
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=60, standardization=False).fit(counter.transform(rows.coalesce(2)))
    m = fitted.coefficientMatrix.toArray()
    weights = {g: [round(float(x), 6) for x in m[:, i]] for i, g in enumerate(counter.vocabulary) if abs(m[:, i]).max() > 1e-4}
    model = Model(classes[:m.shape[0]], weights, [float(x) for x in fitted.interceptVector.toArray()])
    held = saved(rows.where("held").select("corpus", "label", "words"))
    best = None
    for t in TEMPERATURES:
        right = F.element_at("p", F.col("label").cast("int") + 1)
        loss = model.score(held.where("not corpus"), t).agg(F.avg(-F.log(F.greatest(right, F.lit(1e-12)))).alias("x")).first().x
        if loss is not None and (best is None or loss < best):
            best, model.temperature = loss, t
    high = model.score(held.where(F.col("label") == 0.0)).agg(F.max(1.0 - F.element_at("p", 1)).alias("h")).first().h
    model.bound = min(0.9, max(0.5, high or 0.0))
    return model


def scan(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, paragraph (line number from 0), family, probability, template_similarity, confirmed of every paragraph
    that is a licence or has licence evidence (family ``unknown``)."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("paragraph", "line"))
    hold = literal(anchors(list(model.weights)))
    near = lines.where(F.arrays_overlap(F.split(F.lower("line"), "[^a-z0-9]+"), hold)).withColumn("words", words_of(F.col("line")))
    told = model.score(near)
    family = F.slice("p", 2, len(model.classes) - 1)
    names = literal(model.classes[1:])
    told = told.withColumns({"probability": F.array_max(family), "evidence": 1.0 - F.element_at("p", 1)})
    told = told.where(F.col("evidence") >= 0.5).withColumn("best", F.element_at(names, F.array_position(family, F.col("probability")).cast("int")))
    told = told.withColumn("family", F.when(F.col("probability") >= F.lit(model.bound), F.col("best")).otherwise("unknown"))
    told = told.withColumn("own", F.array_distinct(pairs_of(F.col("words"))))
    own = F.col("own")
    texts = [(f, _pairs(t)) for f, ts in FAMILIES.items() for t in ts]
    templates = F.arrays_zip(literal([f for f, _ in texts]), literal([g for _, g in texts]))
    share = lambda t: F.size(F.array_intersect(own, t["1"])) / F.greatest(F.least(F.size(own), F.size(t["1"])), F.lit(1))
    told = told.withColumn("template_similarity", F.coalesce(F.array_max(F.transform(F.filter(templates, lambda t: t["0"] == F.col("best")), share)), F.lit(0.0)))
    return told.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("template_similarity", 6).alias("template_similarity"),
                       ((F.col("family") != "unknown") & (F.col("template_similarity") >= CONFIRM)).alias("confirmed"))


def _pairs(t: str) -> list[str]:
    w = "".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
