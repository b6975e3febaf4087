"""From image vectors to a selection of unique images under facet quotas, with its reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visret.operators import candidates, curate
from visret.operators.encode import Encoder, ensembles
from visret.sources import store
from visret.sources.lineage import cut


def select(images: DataFrame, encoder: Encoder, facets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Picks, counts and coverage report of ``images(image_id, path, embedding)`` under ``facets
    (facet_no, axis, name, prompts, quota)``, the default ones if none are given."""
    facets = cut(curate.default_facets(images.sparkSession) if facets is None else facets)
    scores = cut(candidates.facet_scores(images, ensembles(facets, ["facet_no"], encoder)))
    paths = images.select("image_id", "path")
    picks = cut(curate.allocated(scores, facets).join(paths, "image_id"))
    report = curate.report(scores, facets.select("facet_no", "axis", "name", "quota"))
    best = report.select("facet_no", F.explode("best").alias("b")).select("facet_no", "b.*").join(paths, "image_id")
    best = best.groupBy("facet_no").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("best"))
    return picks, curate.counts(picks, facets), report.drop("best").join(best, "facet_no")


def run(images: DataFrame, encoder: Encoder, folder: str, facets: DataFrame | None = None) -> DataFrame:
    """``select`` written as ``selection`` (a text file of paths), ``counts`` and ``coverage`` (JSON);
    returns the picks."""
    picks, counts, report = select(images, encoder, facets)
    store.write_selection(picks, f"{folder}/selection")
    store.write_report(counts.orderBy("axis", "label"), f"{folder}/counts")
    store.write_report(report.orderBy("facet_no"), f"{folder}/coverage")
    return picks
