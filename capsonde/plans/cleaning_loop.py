"""One turn of the corpus loop: probe results to votes, votes to a patched corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capsonde.operators import cleaning as C
from capsonde.plans.probing import Sweep, at_layers
from capsonde.session import materialize


@dataclass(frozen=True)
class Cleaned:
    removed: DataFrame
    log: DataFrame
    texts: DataFrame
    matches: DataFrame


def clean(sweep: Sweep, texts: DataFrame, matches: DataFrame, manual: DataFrame) -> Cleaned:
    """Texts keep their uids, so hidden states need no second extraction."""
    folds = at_layers(sweep.folds, sweep.best).withColumnRenamed("hold", "dataset_id")
    voted = materialize(C.votes(folds, sweep.results.select("tag", "cluster_id", "lobo_med")))
    removed = materialize(C.removals(voted, manual))
    return Cleaned(
        removed=removed,
        log=C.cleaning_log(voted, manual),
        texts=C.patch_texts(texts, removed),
        matches=C.patch_matches(matches, removed),
    )


def totals(cleaned: Cleaned) -> DataFrame:
    """Removed mappings, edited match records and patched texts."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))

    return (
        one(cleaned.removed, "mappings")
        .unionByName(one(cleaned.matches.filter("edited"), "matches"))
        .unionByName(one(cleaned.texts.filter("patched"), "texts"))
    )
