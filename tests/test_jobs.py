"""Command-line jobs end to end on a small folder of recordings."""

from __future__ import annotations

import argparse
from dataclasses import replace

from test_recordings import noise, write

from sigloom import jobs
from sigloom.operators import protocols
from sigloom.sources import edf


def test_scan_train_score_and_cycles(spark, tmp_path, monkeypatch):
    k = 0
    for g in edf.GROUPS:
        for _ in range(6):
            k += 1
            write(tmp_path / "data" / g / f"s{k}_{20 + k}" / "T-П.edf", noise(k, 30))
    r = protocols.PROTOCOLS["protocol8"]
    monkeypatch.setitem(protocols.PROTOCOLS, "protocol8", replace(r, procedure=replace(r.procedure, candidates=r.procedure.candidates[:2])))
    a = {"data": str(tmp_path / "data"), "out": str(tmp_path / "out"), "protocol": "protocol8", "n_perm": 0, "condition": "rest", "confirm": False, "n_surrogates": 5}
    jobs.scan(spark, argparse.Namespace(**a))
    assert spark.read.parquet(a["out"] + "/registry").count() == 18 * 6
    jobs.train(spark, argparse.Namespace(**a))
    model = jobs.load_model(spark, a["out"] + "/model")
    assert model.metadata["protocol"] == "protocol8" and len(model.coef) == 12
    jobs.evaluate(spark, argparse.Namespace(**{**a, "out": str(tmp_path / "runs" / "one")}))
    report = tmp_path / "runs" / "one" / "metrics"
    assert {r["band"] for r in spark.read.json(str(report / "p" / "age_bands")).collect()} == {"17-29", "30-45", "46-64", "65+"}
    assert spark.read.json(str(report / "metadata" / "auc")).filter("slice = 'all_non_ptsd'").count() == 1
    assert spark.read.csv(str(tmp_path / "runs" / "one" / "metadata_oof"), header=True).count() == 18
    jobs.history(spark, argparse.Namespace(data=str(tmp_path / "runs"), out=str(tmp_path / "out"), runs="one"))
    lines = (tmp_path / "out" / "history.csv").read_text("utf-8-sig").splitlines()
    assert lines[0] == "run,slice,value,ci_low,ci_high" and len(lines) == 6 and lines[1].startswith("one,ageing_and_somatoform,")
    jobs.score(spark, argparse.Namespace(**{**a, "out": str(tmp_path / "pred"), "model": a["out"] + "/model"}))
    pred = spark.read.csv(str(tmp_path / "pred"), header=True, inferSchema=True)
    assert pred.count() == 18 and pred.filter("ptsd_probability BETWEEN 0 AND 1").count() == 18
    jobs.fold_cycles(spark, argparse.Namespace(**a))
    assert spark.read.json(a["out"] + "/rest").count() == 8
    curves = spark.read.parquet(a["out"] + "/curves_rest")
    assert curves.select("channel").distinct().count() == 6 and curves.filter("kind = 'grid' AND channel = 'O1'").count() == 350
    assert spark.read.json(a["out"] + "/channels_rest").filter("p BETWEEN 0 AND 1").count() == 12
