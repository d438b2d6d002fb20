"""Steps whose rows must follow their input, not the product of two sides of one key."""

from pyspark.sql import functions as F

from facetline.operators import planning as P
from facetline.operators import review as V


def test_modules_of_a_file_do_not_meet_all_its_clusters(spark, monkeypatch):
    live = spark.range(400).select("id", F.lit("a.py").alias("path"), F.when(F.col("id") < 200, "module").otherwise("function").alias("kind"), F.lit("source").alias("category"), F.lit(None).cast("long").alias("parent"))
    core = live.where("kind = 'function'").select("id", (F.col("id") - F.col("id") % 2 * (F.col("id") > 390).cast("long")).alias("cluster"))
    ballots, elected = [], P.elected

    def counted(rows, clusters):
        ballots.append(rows.count())
        return elected(rows, clusters)

    monkeypatch.setattr(P, "elected", counted)
    nothing = spark.createDataFrame([], "src long, dst long, kind string, fuzzy boolean")
    owner = {r.id: r.cluster for r in V.attached(core, live, live.select("id"), nothing).collect()}
    assert len(owner) == 400 and {owner[i] for i in range(200)} == {390}
    assert max(ballots) <= 400
