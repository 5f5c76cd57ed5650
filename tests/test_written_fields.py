"""Queries over rules write no more fields of them than they compare."""

import pytest

from specaudit.plans import documents as P
from specaudit.plans.registry import result
from specaudit.sources.views import Model

BODY = ["standard", "acceptable", "unacceptable", "rule_id"]


@pytest.mark.parametrize("name, fields", [("rename_findings", BODY), ("rule_removed", [*BODY, "precedence"]), ("precedence_one_sided", ["precedence"])])
def test_written_fields(spark, monkeypatch, name, fields):
    seen, write = [], P.cut
    monkeypatch.setattr(P, "cut", lambda df: seen.append(df.columns) or write(df))
    result(name, Model(spark, "/root/testdata/sf0.001"))
    assert seen[0] == ["playbook_id", "edition", "position", "name", *fields]
