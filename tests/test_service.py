import time

import pytest

from hopweave.plans.service import QueryService, throughput


def test_results_and_throughput(spark):
    with QueryService(spark, 2) as service:
        found = [service.submit(lambda n=n: spark.range(n).limit(100), pool="small") for n in (3, 5)]
        assert [len(f.result()) for f in found] == [3, 5]
    measured = throughput(spark, [lambda: spark.range(10)] * 4, 2)
    assert measured["queries_per_second"] > 0 and measured["mean_latency"] > 0


def test_cancel_by_tag(spark):
    with QueryService(spark, 2) as service:
        slow = service.submit(lambda: spark.range(0, 1 << 42, 1, 4).selectExpr("sum(hash(id))"), tag="slow")
        quick = service.submit(lambda: spark.range(4))
        time.sleep(2)
        service.cancel("slow")
        with pytest.raises(Exception, match="(?i)cancel"):
            slow.result(timeout=60)
        assert len(quick.result(timeout=60)) == 4
