"""Report files that a query writes and reads again are compressed."""

import glob

from muster.plans import registry
from muster.runtime import shared_dir

SF = "/root/testdata/sf0.001"


def test_written_reports_are_compressed_and_whole(spark):
    for name, tag in (("src_reports", "src"), ("src_labelled", "lab")):
        assert registry.QUERIES[name](spark, SF).select("report_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()
        files = glob.glob(f"{shared_dir(spark).removeprefix('file://')}/muster-{tag}-*/part-*")
        assert files and all(f.endswith(".json.gz") for f in files)
