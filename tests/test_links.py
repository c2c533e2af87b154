"""Links of all movies, against plain Python."""

from quern.queries import movies


def test_same_links_cover_every_movie(spark, tmp_path):
    rows = [("heavy", str(k), "POSITIVE" if k % 3 else "NEGATIVE") for k in range(90)] + [("lone", "x", "POSITIVE"), ("small", "y", "NEGATIVE"), ("small", "z", "NEGATIVE")]
    extra = [rows[0], (None, "n", "POSITIVE"), ("small", "u", None), ("small", None, "NEGATIVE")]
    spark.createDataFrame(rows + extra, "id string, reviewId string, scoreSentiment string").selectExpr("*", "'text' AS reviewText").write.parquet(f"{tmp_path}/reviews.parquet")
    want = {(i, r, c, sum(i == j and c == e and r != q for j, q, e in rows)) for i, r, c in rows} | {("small", None, "NEGATIVE", 0)}
    got = [tuple(r) for r in movies.sem_join_same_links(spark, str(tmp_path)).select("id", "reviewId", "class", "n_links").collect()]
    assert set(got) == want and len(got) == len(want)
