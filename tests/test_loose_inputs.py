"""Exports with loose values and odd payloads, missing paths, records."""

from __future__ import annotations

import datetime
import json
import os

import pytest
from pyspark.errors import AnalysisException

from cadenza.session import scratch_path
from cadenza.sources import schema


def _folder(spark) -> str:
    d = scratch_path(spark, "loose").removeprefix("file:").replace("//", "/")
    os.makedirs(d)
    return d


def _write(path: str, payload, **kw) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, **kw)


def _rec(minute, **kw):
    return {"ts": f"2024-03-01T10:{minute:02d}:00Z", "master_metadata_track_name": "t", **kw}


LOOSE = [
    (_rec(0, ms_played=1234.0, skipped=1, shuffle=0.0), 1234, True, False),
    (_rec(1, ms_played="5000", skipped="true", shuffle="0"), 5000, True, False),
    (_rec(2, ms_played="oops", skipped="maybe", shuffle=None), 0, False, False),
    (_rec(3, ms_played=None, skipped=None, shuffle=True), 0, False, True),
    (_rec(4, ms_played="1e3", skipped=2, shuffle="TRUE"), 1000, True, True),
    (_rec(5, ms_played=99.9, skipped=False, shuffle="false"), 99, False, False),
    (_rec(6, ms_played=12345678901234567, skipped=-1, shuffle=0), 12345678901234567, True, False),
]
WANT = [(ms, a, b) for _, ms, a, b in LOOSE]


@pytest.mark.parametrize("multiline", [True, False])
def test_json_values_are_coerced(spark, multiline):
    d = _folder(spark)
    with open(f"{d}/a.json", "w") as f:
        f.write(json.dumps([r for r, *_ in LOOSE], indent=1) if multiline else "\n".join(json.dumps(r) for r, *_ in LOOSE))
    rows = schema.read_plays(spark, d, multiline=multiline).orderBy("ts").collect()
    assert [(r.ms_played, r.skipped, r.shuffle) for r in rows] == WANT


def test_records_are_coerced(spark):
    rows = schema.from_records(spark, [r for r, *_ in LOOSE]).orderBy("ts").collect()
    assert [(r.ms_played, r.skipped, r.shuffle) for r in rows] == WANT
    odd = [{"ts": datetime.datetime(2024, 3, 1, 10, tzinfo=datetime.timezone.utc), "master_metadata_track_name": 7, "ms_played": float("nan"), "extra": []},
           {"ts": None, "master_metadata_track_name": "x"}, {"master_metadata_track_name": "x"}]
    got = schema.from_records(spark, odd, user_id=3).collect()
    assert [(r.user_id, str(r.ts), r.track, r.ms_played) for r in got] == [(3, "2024-03-01 10:00:00", "7", 0)]
    assert schema.from_records(spark, []).count() == 0


def test_payloads_that_are_no_list_are_skipped(spark):
    d = _folder(spark)
    _write(f"{d}/list.json", [_rec(0), _rec(1)], indent=2)
    _write(f"{d}/one.json", _rec(2), indent=2)
    _write(f"{d}/text.json", "hello")
    with open(f"{d}/blank.json", "w") as f:
        f.write("\n \t\n  [" + json.dumps(_rec(3)) + "]")
    assert [str(r.ts)[14:16] for r in schema.read_plays(spark, d).orderBy("ts").collect()] == ["00", "01", "03"]


def test_missing_paths(spark):
    d = _folder(spark)
    _write(f"{d}/good.json", [_rec(0)])
    for paths in ([f"{d}/none.json"], [f"{d}/good.json", f"{d}/none.json"]):
        with pytest.raises(AnalysisException):
            schema.read_plays(spark, paths)
    assert schema.read_plays(spark, [f"{d}/good.json", f"{d}/no-*.json"]).count() == 1
    assert schema.read_plays(spark, f"{d}/g*.json").count() == 1
    empty = schema.read_plays(spark, f"{d}/no-*.json")
    assert empty.count() == 0 and empty.schema == schema.PLAY_SCHEMA
