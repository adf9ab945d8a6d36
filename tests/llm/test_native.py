"""Operators that must stay native hold no Python on the executors."""

import re

import pytest

from httplens.llm import mixing, secret_scan


@pytest.mark.parametrize("op", [secret_scan.secrets, secret_scan.redact, mixing.mix, mixing.mixed])
def test_native_plans(docs, op, monkeypatch):
    plans = []
    for module in (secret_scan, mixing):
        own = module.staged
        monkeypatch.setattr(module, "staged", lambda df, own=own: plans.append(df) or own(df))
    plans.append(op(docs))
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", text.replace("ExistingRDD", ""))
