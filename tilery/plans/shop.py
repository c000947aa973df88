"""The shop's lexicon: catalogue items as entities, with small domains of order words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilery.functions.terms import TermModel
from tilery.operators.lexicon import Lexicon, build_lexicon
from tilery.schemas import ITEM

ORDER = ["entities", "quantifiers", "intents"]
KINDS = {"entities": "ENTITY", "quantifiers": "QUANTIFIER", "intents": "INTENT"}

_INTENTS = [
    (1, "ADD_TO_ORDER", ["exact:I'd like", "exact:please add", "exact:give me", "exact:we need", "exact:can I have", "exact:I want"]),
    (2, "CONJUNCTION", ["exact:(and,also,plus,with)"]),
    (3, "END_OF_ORDER", ["exact:that's all", "exact:please", "exact:(thanks,thank you)"]),
]
_QUANTIFIERS = [(1, "one", ["exact:(a,an,the)"]), (0, "none", ["exact:no"])]


def shop_items(catalog: DataFrame) -> DataFrame:
    """Items of all domains."""
    spark = catalog.sparkSession
    entities = catalog.select(F.lit("entities").alias("domain"), "ord", "pid", "name", "aliases")
    rows = [("quantifiers", i, p, n, a) for i, (p, n, a) in enumerate(_QUANTIFIERS)] + [("intents", i, p, n, a) for i, (p, n, a) in enumerate(_INTENTS)]
    return reduce(DataFrame.unionByName, [entities, spark.createDataFrame(rows, ITEM)])


def shop_lexicon(spark: SparkSession, sf_dir: str, model: TermModel = TermModel()) -> Lexicon:
    return build_lexicon(shop_items(spark.read.parquet(f"{sf_dir}/catalog_items.parquet")), ORDER, model)
