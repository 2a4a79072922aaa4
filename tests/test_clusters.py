"""The enrichment count takes part in the clustering features."""

from ioclens.plans import ml
from ioclens.sources import views
from tests.conftest import SMALL


def test_clusters_use_enrichment_counts(spark):
    want = {r.id: 0 for r in views.ioc(spark, SMALL).select("id").collect()}
    want.update(views.enrichment(spark, SMALL).groupBy("ioc_id").count().collect())
    rows = ml._clusters(spark, SMALL).select("id", "enrichment_count").collect()
    assert len(rows) == len(want) and {r.enrichment_count for r in rows} == {0, 1, 2}
    assert all(r.enrichment_count == want[r.id] for r in rows)
