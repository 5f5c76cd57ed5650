"""Views that Spark runs in a form of its own: the same rows, with each text sent out no more often than needed."""

import re

import pytest

from specaudit.sources.views import VIEWS, Model, needs


@pytest.mark.parametrize("name", ["a_prompt_version", "a_instructions"])
def test_texts_are_sent_to_their_order_and_to_their_owner_only(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        m = Model(spark, "/root/testdata/sf0.001")
        here = getattr(m, name)
        plain = spark.sql(VIEWS[name], **{dep: getattr(m, dep) for dep in needs(name)})
        assert here.schema == plain.schema and here.count() > 0
        assert here.exceptAll(plain).isEmpty() and plain.exceptAll(here).isEmpty()
        plan = here._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        sent = re.findall(r"Exchange\s*\nInput[^\n]*\b(?:text|full_text)#[^\n]*\nArguments: hashpartitioning", plan)
        assert 0 < len(sent) <= 2, plan
    finally:
        spark.conf.set(key, before)


def test_text_sites_puts_the_texts_together_once(spark):
    from specaudit.plans import all_builders

    plan = all_builders()["text_sites"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_document_level_parses_the_rules_once(spark):
    from specaudit.plans import all_builders

    plan = all_builders()["document_level"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_collect_list") == 1
