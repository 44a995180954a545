"""Plan guards: no Python UDF node, no cartesian product or nested-loop join in
any registered query; scans read only the columns used."""

import re

from keysweep.plans import registry

from conftest import SF_SMALL

FORBIDDEN = re.compile(r"BatchEvalPython|ArrowEvalPython|CartesianProduct|BroadcastNestedLoopJoin|MapInPandas")


def test_no_python_or_pairwise_nodes(spark):
    for name, fn in registry.SPARK.items():
        if name in ("scan_stream", "report_sink", "analysis_sink"):
            continue  # these return a read of their written output
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not FORBIDDEN.search(plan), name


def test_document_scans_prune_columns(spark):
    plan = registry.SPARK["detect"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas == {"doc_id:bigint,text:string"}  # lang, source, n_chars never read


def test_text_is_not_shuffled_unless_the_caller_asks(spark):
    from keysweep.sources.tables import SPREAD_CONF
    for name in ("detect", "redact_text"):
        plan = lambda: registry.SPARK[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan().replace("BroadcastExchange", "")
        spark.conf.set(SPREAD_CONF, "6")
        try:
            assert "hashpartitioning" in plan()
        finally:
            spark.conf.unset(SPREAD_CONF)


def test_severity_breakdown_and_snippets_detect_once(spark):
    for name in ("severity_breakdown", "scan_snippets"):
        plan = registry.SPARK[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate posexplode(arrays_zip") == 1, name
