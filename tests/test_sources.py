import json

import pytest

from fieldtrial.operators import curves, prep
from fieldtrial.plans import sweep
from fieldtrial.sources import catalog, files, results


def test_catalog():
    assert len(catalog.names()) == 9
    assert catalog.get("synthetic_5d").n_features == 5
    with pytest.raises(ValueError):
        catalog.get("nothing")


def test_dataset_csv_to_xy(spark, tmp_path):
    path = tmp_path / "plate.csv"
    path.write_text(",a,b,Round,mean A450,sd A450\n0,1,2,1,0.5,0.2\n1,3,4,1,0.7,0.1\n")
    columns = catalog.csv_columns(spark, str(path))
    assert list(columns) == ["Unnamed: 0", "a", "b", "Round", "mean A450", "sd A450"]
    df = catalog.read_dataset(spark, str(path), columns)
    spec = catalog.get("df_Human_Hela_regular_mode")
    rows = [tuple(r) for r in prep.to_xy(df, spec).collect()]
    assert rows[0][0] == [1.0, 2.0] and rows[0][1] == 0.5 and rows[0][2] == pytest.approx(0.04)
    catalog.register(df, spec)
    assert spark.table(spec.name).count() == 2


def test_named_features_and_targets(spark):
    spec = catalog.get("df_Human_T_Cell_Expanded")
    cols = [*spec.features, "Cell count", "PosCont FC"]
    df = spark.createDataFrame([tuple(float(i) for i in range(14)) + (6.0, 2.0)], ", ".join(f"`{c}` double" for c in cols))
    row = prep.to_xy(df, spec).first()
    assert row["x"] == [float(i) for i in range(14)] and row["y_var"] == 0.0
    assert row["y"] == pytest.approx(1.3862943611198906)


def test_text_table_with_breaks_quotes_and_bom(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿Key,Note\nA,\"two\nlines, \"\"quoted\"\"\"\nB,\n".encode())
    got = {r["Key"]: r["Note"] for r in results.read_text_table(spark, str(path)).collect()}
    assert got == {"A": 'two\nlines, "quoted"', "B": ""}
    kept = {r["Key"]: r["Note"] for r in results.read_text_table(spark, str(path), None).collect()}
    assert kept["B"] is None


def competition(**steps):
    return {"optimizer_results": {k: {"steps_to_target": v, "found_target": True} for k, v in steps.items()}}


LAYOUTS = {
    "set_a_Hard_Mode_Batch1.json": {"tournament_results": {"competitions": [competition(A=3, B=4), competition(A=5)]}},
    "set_b_Easy_Batch10.json": {"tournament_results": [{"competitions": [competition(A=1)]}, {"competitions": [competition(A=2)]}, {"none": 1}]},
    "regular_mode_x.json": {"all_tournament_results": [{"competitions": [competition(B=7)]}]},
    "Hard_Batch2.json": {"competitions": [competition(C=8), {"other": 1}]},
    "w_Hard_Batch3.json": {"results": {"all_tournament_results": [{"competitions": [competition(D=9)]}]}},
    "v_Hard_Batch4.json": {"files": [{"data": {"tournament_results": {"competitions": [competition(E=2)]}}}, {"data": {"competitions": [competition(F=6)]}}]},
    "nothing.json": {"other": 3},
}


def test_every_layout(spark, tmp_path):
    for name, data in LAYOUTS.items():
        (tmp_path / name).write_bytes(("﻿pl" + json.dumps(data)).encode())
    got = sorted(
        (r["dataset"], r["batch"], r["instance"], r["optimizer"], r["steps_to_target"])
        for r in results.read_results(spark, str(tmp_path)).collect()
    )
    assert got == sorted([
        ("set_a", "Batch1", "set_a_Batch1_comp0", "A", 3.0), ("set_a", "Batch1", "set_a_Batch1_comp0", "B", 4.0),
        ("set_a", "Batch1", "set_a_Batch1_comp1", "A", 5.0), ("set_b", "Batch10", "set_b_Batch10_comp0", "A", 1.0),
        ("set_b", "Batch10", "set_b_Batch10_comp0", "A", 2.0), ("Unknown", "Unknown", "Unknown_Unknown_comp0", "B", 7.0),
        ("Unknown", "Batch2", "Unknown_Batch2_comp0", "C", 8.0), ("w", "Batch3", "w_Batch3_comp0", "D", 9.0),
        ("v", "Batch4", "v_Batch4_comp0", "E", 2.0), ("v", "Batch4", "v_Batch4_comp0", "F", 6.0),
    ])


def test_final_best_sources(spark, tmp_path):
    data = {"tournament_results": {"competitions": [{"optimizer_results": {
        "LIST": {"best_value_so_far": [1.0, 4.0], "optimization_history": [{"step": 0, "best_value_so_far": 9.0}]},
        "HIST": {"optimization_history": [{"step": 0, "best_value_so_far": 2.0}, {"step": 1, "best_value_so_far": 3.0}]},
        "VALUE": {"best_value_so_far": 5.5}, "NONE": {}}}]}}
    (tmp_path / "r.json").write_text(json.dumps(data))
    got = {r["optimizer"]: r["final_best"] for r in results.read_results(spark, str(tmp_path)).collect()}
    assert got == {"LIST": 4.0, "HIST": 3.0, "VALUE": 5.5, "NONE": None}
    assert results.valid_results(results.read_results(spark, str(tmp_path)), "final_best").count() == 3


def test_optimizer_stats(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"optimizer_stats": {
        "A": {"mean_steps": 4.0, "std_steps": 2.0, "n_competitions": 16}, "B": {"std_steps": 1.0},
        "C": {"mean_steps": 1.0, "count": 4}}}))
    got = {r["optimizer"]: (r["mean_steps"], r["std_steps"], r["n"])
           for r in results.read_optimizer_stats(spark, str(tmp_path)).collect()}
    assert got == {"A": (4.0, 2.0, 16), "C": (1.0, None, 4)}


def test_cells_are_written_and_resumed(spark, tmp_path):
    cells = sweep.sweep_grid(sweep.hard_presets(spark))
    assert cells.count() == 48
    hard = cells.where("combo = 'RF_Hard' and dataset = 'df_Human_T_Cell_Expanded'").first()
    assert (hard["noise_level"], hard["heteroscedastic"], hard["n_modes"]) == (0.2, True, 2)
    path = str(tmp_path / "cells")
    results.write_cells(cells.where("combo = 'RF_Hard'"), path)
    done = spark.read.json(path)
    left = sweep.pending_cells(cells, done, ["combo", "dataset"])
    assert left.count() == 42 and left.where("combo = 'RF_Hard'").isEmpty()


def test_file_groups(spark, tmp_path):
    for name in ("Smith 2019 - Title.pdf", "Lee_2021 - SI.pdf", "Smith 2019 -SI.docx"):
        (tmp_path / name).write_text("x")
    listed = files.list_files(spark, str(tmp_path))
    got = files.group_files(listed, "path")
    assert sorted(r["key"] for r in got.collect()) == ["Lee", "Smith 2019", "Smith 2019"]


def test_sweep_and_selection(spark):
    df = spark.createDataFrame([("RANDOM", 200_000), ("BO", 5)], "optimizer string, steps_to_target int")
    caps = spark.createDataFrame(list(prep.STEP_CAPS.items()), "optimizer string, max_steps int")
    got = {r["optimizer"]: (r["steps_to_target"], r["max_steps_capped"]) for r in prep.apply_step_cap(df, caps).collect()}
    assert got == {"RANDOM": (100_000, True), "BO": (5, False)}
    with pytest.raises(ValueError):
        prep.select_optimizers(df, ["NO_SUCH"])
    assert curves.has_data(df, {"steps_to_target": 5}) and not curves.has_data(df, {"steps_to_target": 6})


def test_mean_trajectory_holds_the_last_value(spark):
    df = spark.createDataFrame(
        [("o", 1, 0, 1.0), ("o", 1, 1, 3.0), ("o", 2, 0, 2.0), ("o", 2, 1, 1.0), ("o", 2, 3, 8.0), ("o", 3, 0, 5.0)],
        "optimizer string, run int, step int, value double")
    for block in (1, 2, 100):
        got = {r["step"]: (r["mean_best"], r["n_runs"]) for r in
               curves.mean_trajectory(df, ["optimizer"], ["run"], block).collect()}
        assert got == {0: (8 / 3, 3), 1: (10 / 3, 3), 2: (4.0, 2), 3: (16 / 3, 3)}


def test_schedule_with_a_short_last_batch(spark):
    df = spark.createDataFrame([("c", 20, 10, 4), ("d", 10, 10, 3)], "c string, S int, R int, B int")
    got = [(r["c"], r["step"], r["batch_size"], r["evaluations"]) for r in curves.eval_schedule(df, ["c"]).orderBy("c", "step").collect()]
    assert got == [("c", 0, 10, 10), ("c", 1, 4, 14), ("c", 2, 4, 18), ("c", 3, 2, 20), ("d", 0, 10, 10)]


def _arrival(spark, folder, name, rows):
    lines = [
        '{"competitions": [{"optimizer_results": {"%s": {"steps_to_target": %s, "found_target": true, "final_best": %s}}}]}' % r
        for r in rows
    ]
    (folder / name).write_text("\n".join(lines))


def test_stream_adds_each_arrival_once(spark, tmp_path):
    from fieldtrial.streaming.results_stream import append_once, stream_results, totals_snapshot

    folder, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    folder.mkdir()
    _arrival(spark, folder, "a.json", [("A", 3, 1.0), ("B", 5, 2.0), ("A", "null", 7.0)])
    arriving = stream_results(spark, str(folder), lines=True).drop("history")
    append_once(arriving, table, state)
    assert spark.read.parquet(table).count() == 3
    append_once(arriving, table, state)
    assert spark.read.parquet(table).count() == 3
    _arrival(spark, folder, "b.json", [("A", 9, 4.0)])
    append_once(arriving, table, state)
    # A driver that dies after the rows are written and before the batch is recorded runs it again.
    for kept in (tmp_path / "state" / "commits").glob("*1*"):
        kept.unlink()
    append_once(arriving, table, state)
    rows = spark.read.parquet(table).select("optimizer", "final_best").collect()
    assert sorted(map(tuple, rows)) == [("A", 1.0), ("A", 4.0), ("A", 7.0), ("B", 2.0)]

    totals = {r["optimizer"]: r for r in totals_snapshot(arriving, str(tmp_path / "sums"), str(tmp_path / "state2")).collect()}
    assert totals["A"]["n_competitions"] == 3 and totals["A"]["mean_steps"] == 6.0 and totals["A"]["std_steps"] == 3.0
    _arrival(spark, folder, "c.json", [("A", 6, 4.0), ("C", "null", 1.0)])
    totals = {r["optimizer"]: r for r in totals_snapshot(arriving, str(tmp_path / "sums"), str(tmp_path / "state2")).collect()}
    assert totals["A"]["n_competitions"] == 4 and totals["A"]["std_steps"] == pytest.approx(6**0.5)
    assert totals["C"]["mean_steps"] is None and totals["C"]["std_steps"] is None
