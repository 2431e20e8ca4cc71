import json

from perigee.functions.tle import SPARK
from perigee.operators import records
from perigee.streaming import pairing


def test_stream_pairs_like_the_batch(spark, tmp_path):
    kinds = {"1": "1 a", "2": "2 b", "X": "zz", "-": " "}
    rows = [("tle1", n + 1, kinds[k]) for n, k in enumerate("112X2-112-2")] + [("tle2", n + 1, kinds[k]) for n, k in enumerate("21-2")]
    (tmp_path / "in").mkdir()
    for part, (a, b) in enumerate(((0, 4), (4, 9), (9, len(rows)))):
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps({"src_file": f, "line_no": n, "raw": r}) for f, n, r in rows[a:b]))
    lines = spark.readStream.schema("src_file string, line_no long, raw string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = pairing.paired_stream(lines, None).writeStream.format("memory").queryName("paired").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
    got = {(r.src_file, r.src1, r.src2, r.rule_id) for r in spark.table("paired").collect()}
    spark.createDataFrame(rows, "src_file string, line_no long, raw string").createOrReplaceTempView("stream_lines")
    want = {(r.src_file, r.src1, r.src2, r.rule_id) for r in spark.sql(records.paired(SPARK, "SELECT * FROM stream_lines")).collect()}
    assert got == want
