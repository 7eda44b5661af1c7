"""Rounds of components let go of their files."""

from __future__ import annotations

from askwell.llm import components as C


def test_every_finished_round_is_released(spark, monkeypatch):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1001)], "a long, b long")
    rounds, release = [], C.release
    monkeypatch.setattr(C, "release", lambda s: rounds.append(release(s)))
    found = {(r["node"], r["root"]) for r in C.components(chain).collect()}
    assert found == {(i, 0) for i in range(61)} | {(1000, 1000), (1001, 1000)} and len(rounds) > 1
