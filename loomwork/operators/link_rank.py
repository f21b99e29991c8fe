"""The link ranking: caps against floods, then a ranked summary of each root."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.ranking import cap_per_group, mode_with_count
from loomwork.sources.storage import staged


def capped_links(links: DataFrame, most: int = 3) -> DataFrame:
    """At most `most` mentions of one url and then of one author under each root, the earliest by link_id."""
    per_url = cap_per_group(links, ["root", "url"], ["link_id"], most)
    return cap_per_group(per_url, ["root", "author"], ["link_id"], most)


def rank_roots(links: DataFrame, library: str, least: int = 2, deny: Sequence[str] = ()) -> DataFrame:
    """(root, n_links, top_author, top_channel, n_library): roots with at least `least` capped links, not denied.

    Of equally frequent authors or channels the least is named.
    """
    kept = capped_links(links.where(~F.col("root").isin(*deny)) if deny else links)
    kept = staged(kept.select("root", "author", "channel"), "kept-links")  # counted in three ways
    counts = kept.groupBy("root").agg(F.count("*").alias("n_links"), F.count_if(F.col("channel") == library).alias("n_library")).where(F.col("n_links") >= least)
    return (
        counts.join(mode_with_count(kept, ["root"], "author", "top_author"), "root")
        .join(mode_with_count(kept, ["root"], "channel", "top_channel"), "root")
        .select("root", "n_links", "top_author", "top_channel", "n_library")
    )
