"""Clusters and mentions to prompts; judged replies to candidate abilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from capsonde.operators import abilities as A
from capsonde.operators import judging as J
from capsonde.session import materialize


@dataclass(frozen=True)
class Refinement:
    """Outputs of a refinement; all are lazy and share the parsed replies."""

    judgments: DataFrame
    rejects: DataFrame
    summary: DataFrame
    raw_abilities: DataFrame
    final_abilities: DataFrame


def prompts(
    clusters: DataFrame, mentions: DataFrame, done: DataFrame | None = None,
    limit: int | None = None, most: int = J.MAX_MENTIONS,
) -> DataFrame:
    """Prompts still to be judged; `limit` takes the first clusters only, as a pilot."""
    if limit:
        clusters = clusters.orderBy("pos").limit(limit)
    rows = J.prepare_prompts(clusters, mentions, most)
    return rows.join(done.select("cluster_id").distinct(), "cluster_id", "left_anti") if done is not None else rows


def refine(
    results: DataFrame, keep_no_contrast: bool = False, keep_narrow: bool = False, store: bool = False
) -> Refinement:
    """`store` writes the parsed replies once, for callers who read several outputs."""
    parsed = J.parse_replies(results)
    if store:
        parsed = materialize(parsed)
    judged = J.judgments(parsed)
    raw = J.abilities(judged)
    return Refinement(
        judgments=judged,
        rejects=J.rejects(parsed),
        summary=J.summary_counts(parsed),
        raw_abilities=raw,
        final_abilities=A.build_final(raw, keep_no_contrast, keep_narrow),
    )
