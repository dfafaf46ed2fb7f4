"""Runs a group of configurations over CSV segments: matrices and a summary as CSV; python -m tributary.plans.runner --config F.

Files of configurations are the driver's. Data, truth and results lie where their paths say: a path with a scheme (hdfs://, file:/ on a shared
disk, ..) is read and written by Spark, any other is a file of the driver's; matrices and summaries are as large as the model, not the data.
"""

from __future__ import annotations

import argparse
import csv
import os
import re
import time
import traceback
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import metrics
from ..sources import panel as P
from ..sources.shared import remote
from . import config, engine, inference

#: Cells as they are: quotes doubled, line breaks within cells, nothing trimmed.
CSV = {"header": True, "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
MATRICES = {"minimum": (), "matrices": ("p_value", "f_test", "wald_test", "lr_test", "sign")}


def file_name(idx: int, backend: str | None, params: dict, suffix: str) -> str:
    clean = lambda x: re.sub(r"[^A-Za-z0-9._-]+", "-", str(x)).strip("-")
    parts = [f"case_{idx:03d}", clean(backend or "newton"), *(f"{clean(k)}_{clean(v)}" for k, v in params.items() if k != "backend"), suffix]
    return "_".join(parts) + ".csv"


def joined(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if remote(folder) else os.path.join(folder, name)


def write_rows(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence], path: str) -> None:
    """A small CSV file with a header; a folder with one such file where Spark writes it."""
    if remote(path):
        text = [[None if x is None else str(x) for x in r] for r in rows]
        spark.createDataFrame(text, ", ".join(f"`{n}` string" for n in names)).coalesce(1).write.mode("overwrite").options(**CSV).csv(path)
        return
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(names)
        out.writerows(rows)


def read_rows(spark: SparkSession, path: str) -> tuple[list[str], list[list[str | None]]]:
    """Header and rows of such a file."""
    if remote(path):
        df = spark.read.options(**CSV).csv(path)
        return df.columns, [list(r) for r in df.collect()]
    with open(path, encoding="utf-8", newline="") as f:
        first, *rows = csv.reader(f)
    return first, rows


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A matrix of effects x causes as one CSV file; its size is that of the model, not of the data."""
    write_rows(matrix.sparkSession, matrix.columns, sorted(matrix.collect(), key=lambda r: r["effect"]), path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long rows effect, cause, value of a matrix file; the first column names the effects."""
    names, rows = read_rows(spark, path)
    cells = [(r[0], c, float(v) if v not in (None, "") else None) for r in rows for c, v in zip(names[1:], r[1:], strict=True)]
    return spark.createDataFrame(cells, "effect string, cause string, value double")


def write_summary(spark: SparkSession, rows: list[dict], path: str) -> None:
    names = list(dict.fromkeys(k for r in rows for k in r))
    write_rows(spark, names, [[r.get(n) for n in names] for r in rows], path)


def run(spark: SparkSession, path: str, save: str = "minimum", test: str = "f") -> list[dict]:
    """All cases of a run file; a case that fails is a row that says so. Returns the summary's rows."""
    if save not in MATRICES or test.lower() not in inference.TESTS:
        raise ConfigError(f"save must be one of {list(MATRICES)}, test one of {sorted(inference.TESTS)}")
    base = os.path.dirname(os.path.abspath(path))
    cfg = config.read(path)
    out_dir = cfg.get("output_dir", "results")
    if not remote(out_dir):
        out_dir = os.path.join(base, out_dir)
        os.makedirs(out_dir, exist_ok=True)
    group_path = P.resolve(cfg["group_config_path"], base)
    truth = read_matrix(spark, P.resolve(cfg["ground_truth_path"], base)) if cfg.get("ground_truth_path") else None
    data = cfg["data"]
    panel = P.read_csv(spark, data["csv_paths"], data.get("index_col"), data.get("order_col"), base)
    panel = panel.with_df(panel.df.persist(), panel.index, panel.whole)
    threshold, prepared, summary = float(cfg.get("threshold", 0.01)), {}, []
    mark = engine.fingerprint(panel)
    for idx, (raw, params) in enumerate(config.cases(config.read(group_path)), 1):
        row = {"case_id": idx, "backend": raw.get("backend"), "test_type": test, "status": "OK"}
        began = time.perf_counter()
        try:
            case = config.normalised(raw, os.path.dirname(group_path))
            row["backend"] = case.get("backend")
            _, effects, _ = P.check_roles(panel.variables, case.get("causes"), case.get("effects"), case.get("tested_causes"))
            keys = ("lag_config", "lag_selector", "stationarity_transformer", "x_scaler", "y_scaler", "backend_sample_fraction", "backend_max_samples")
            signature = (mark, tuple(effects), *(repr(case.get(k)) for k in keys))
            spent = 0.0
            if signature not in prepared:
                names = {"lag_config": "config", "lag_selector": "selector", "stationarity_transformer": "transformer", "backend_sample_fraction": "sample_fraction", "backend_max_samples": "max_samples"}
                made = engine.prepare(panel, effects, **{names.get(k, k): case[k] for k in keys if case.get(k) is not None})
                prepared[signature] = made, time.perf_counter() - began
            else:
                spent = prepared[signature][1]
            args = {k: v for k, v in case.items() if k not in (*keys, "backend", "reuse_data", "data", "effects")}
            results = engine.MultiTaskCausality(case.get("backend")).fit(effects=effects, prepared_data=prepared[signature][0], **args)
            row["execution_time_seconds"] = round(time.perf_counter() - began + spent, 2)
            name = file_name(idx, case.get("backend"), params, "causality")
            write_matrix(inference.wide(results.result(threshold, test=test), results.causes), joined(out_dir, name))
            row["causality_file"] = name
            for column in MATRICES[save]:
                source = inference.TESTS[test.lower()] if column == "p_value" else column
                extra = file_name(idx, case.get("backend"), params, column)
                write_matrix(results.matrix(source), joined(out_dir, extra))
                row[f"{column}_file"] = extra
            row |= params
            if truth is not None:
                row |= metrics.evaluate(truth, read_matrix(spark, joined(out_dir, name))).first().asDict()
        except Exception as e:  # a failed case must not end the sweep
            row |= {"status": "FAILED", "error": f"{type(e).__name__}: {e}"[:300], "traceback": traceback.format_exc(limit=-5), "execution_time_seconds": round(time.perf_counter() - began, 2)} | params
        summary.append(row)
    panel.df.unpersist()
    write_summary(spark, summary, joined(out_dir, "summary.csv"))
    return summary


def recalculate(spark: SparkSession, out_dir: str, truth_path: str, keep: bool = False) -> list[dict]:
    """Metrics anew from saved matrices, signed ones as 0 and 1; writes summary_recalculated.csv."""
    truth = read_matrix(spark, truth_path)
    names, cells = read_rows(spark, joined(out_dir, "summary.csv"))
    rows = [dict(zip(names, r, strict=True)) for r in cells]
    for row in rows:
        if name := row.get("causality_file"):
            matrix = read_matrix(spark, joined(out_dir, name))
            binary = matrix.withColumn("value", F.when(F.col("value") != 0, 1).otherwise(0))
            row |= metrics.evaluate(truth, binary).first().asDict()
            if keep:
                causes = [r["cause"] for r in matrix.select("cause").distinct().collect()]
                write_matrix(inference.wide(binary, sorted(causes)), joined(out_dir, name.replace(".csv", "_binary.csv")))
    write_summary(spark, rows, joined(out_dir, "summary_recalculated.csv"))
    return rows


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--config", required=True)
    parser.add_argument("--save", choices=list(MATRICES), default="minimum")
    parser.add_argument("--test", choices=["f", "wald", "lr"], default="f")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for row in run(spark, a.config, a.save, a.test):
        print(row)


if __name__ == "__main__":
    main()
