"""From a file to a tidy table: encode, analyse, plan, apply, validate, save, with a log of every stage."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..operators import profile as P
from ..operators.tidy import ROW
from ..sources import tables
from . import encode as E
from . import planner as pl
from .plan import Plan
from .validate import Report, feedback, validate


@dataclass
class Config:
    """Settings; from_dict takes the nested form of a configuration file."""

    encoder: E.Options = field(default_factory=E.Options)
    data_only: bool = True
    max_retries: int = 3
    output_format: str = "csv"
    output_encoding: str = "utf-8"
    save_intermediate: bool = True
    output_dir: str = "output"
    max_unique_values: int = 100
    #: Rows that the profile of a larger table is taken of; None: all of them.
    metadata_sample_size: int | None = None
    detect_implicit_aggregates: bool = True

    @staticmethod
    def from_dict(raw: dict) -> Config:
        e, out, log, gen, analyzer = (raw.get(k) or {} for k in ("encoder", "output", "logging", "generator", "analyzer"))
        options = E.Options(
            k=e.get("anchor_neighborhood", 2),
            detect_subtables=e.get("detect_subtables", True),
            longest_value=e.get("max_value_len", 200),
            min_cells=e.get("min_nonempty_cells_for_region", 8),
            profile=e.get("profile", "v2"),
        )
        return Config(
            options,
            data_only=e.get("data_only", True),
            max_retries=gen.get("max_retries", 3),
            output_format=out.get("format", "csv"),
            output_encoding=out.get("encoding", "utf-8"),
            save_intermediate=log.get("save_intermediate", True),
            output_dir=log.get("output_dir", "output"),
            max_unique_values=e.get("max_unique_values", 100),
            metadata_sample_size=e.get("metadata_sample_size"),
            detect_implicit_aggregates=analyzer.get("detect_implicit_aggregates", True),
        )


@dataclass
class Result:
    table: DataFrame
    plan: Plan
    validation: Report
    log: dict
    output: str | None
    intermediate: dict


class Normalizer:
    def __init__(self, spark: SparkSession, config: Config | None = None, planner: pl.Planner | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.planner = planner or (pl.RulePlanner() if self.config.detect_implicit_aggregates else pl.RulePlanner(max_implicit_columns=0))

    def encode(self, path: str) -> dict:
        """Encoding of the first sheet as text and metadata, and the table itself."""
        cells = tables.read_cells(self.spark, path, self.config.data_only)
        encoding = E.encode(cells, self.config.encoder, Path(path).name)
        first = next(iter(encoding["sheets"]), "")
        sizes = encoding["compression_metrics"]["sheets"].get(first, {})
        table = tables.read_table(self.spark, path)
        return self._described(table, encoding, first, sizes)

    def encode_table(self, table: DataFrame) -> dict:
        """The same for a table with numbered rows."""
        from pyspark.sql import functions as F

        from ..operators.model import cells_from_table

        cells = cells_from_table(table.withColumn(ROW, F.col(ROW) + 1), ROW, header_style=True)
        encoding = E.encode(cells, self.config.encoder)
        first = next(iter(encoding["sheets"]), "")
        return self._described(table, encoding, first, encoding["compression_metrics"]["sheets"].get(first, {}))

    def _described(self, table: DataFrame, encoding: dict, sheet: str, sizes: dict) -> dict:
        most = self.config.metadata_sample_size
        profiled = table if most is None else P.sample(table, most, ROW)
        columns = [r.asDict(True) for r in P.profile(profiled, ROW, self.config.max_unique_values).orderBy("ordinal").collect()]
        shape = (table.count() if most is not None else columns[0]["n_rows"] if columns else 0, len(columns))
        first: dict = {}
        for r in sorted(P.first_values(table, ROW, 3).collect(), key=lambda r: r["rank"]):
            first.setdefault(r["column"], []).append(r["value"][:50])
        metadata = {
            "original_shape": shape,
            "column_names": [c["column"] for c in columns],
            "dtypes": {c["column"]: c["dtype"] for c in columns},
            "null_counts": {c["column"]: c["n_null"] for c in columns},
            "compression_ratio": sizes.get("overall_ratio", 0),
            "compression_stages": sizes,
            "sample_values": {c["column"]: first.get(c["column"], []) for c in columns},
            "columns": columns,
            "issues": [f"Multi-language column: {c}" for c in P.multi_language_columns(table.drop(ROW))],
        }
        text = E.readable_text(sheet, encoding["sheets"].get(sheet, {}), sizes)
        return {"encoded_text": text, "metadata": metadata, "original_shape": shape, "encoding": encoding, "dataframe": table}

    def normalize(self, path: str, output: str | None = None) -> Result:
        began = time.time()
        log: dict = {"input_file": path, "start_time": time.strftime("%Y-%m-%d %H:%M:%S"), "stages": {}}
        try:
            encoded = self.encode(path)
            table = encoded["dataframe"].cache()
            log["stages"]["encoding"] = {"status": "success", "shape": encoded["original_shape"], "compression_ratio": encoded["metadata"]["compression_ratio"]}
            self._keep("01_encoded_data.json", {"metadata": encoded["metadata"], "encoded_text_preview": encoded["encoded_text"][:2000]})

            analysis = self.planner.analyze(table)
            log["stages"]["structure_analysis"] = {"status": "success", "transformation_complexity": analysis.complexity, "findings": analysis.findings}
            self._keep("02_structure_analysis.json", analysis.document())

            schema = self.planner.schema(table, analysis)
            log["stages"]["schema_estimation"] = {"status": "success", "observation_unit": schema.unit, "num_target_columns": len(schema.columns), "expected_rows": schema.rows}
            self._keep("03_schema.json", schema.document())

            result, plan, checked, attempts = self._transform(table, analysis, schema)
            log["stages"]["transformation"] = {"status": "success", "output_shape": checked.shape, "validation": checked.document(), "attempts": attempts}
            self._keep("04_transformation_plan.json", plan.steps)

            target = output or str(Path(self.config.output_dir) / "normalized_output.csv")
            log["output_file"] = tables.save(result, target, self.config.output_format, self.config.output_encoding)
            log |= {"end_time": time.strftime("%Y-%m-%d %H:%M:%S"), "elapsed_seconds": round(time.time() - began, 2), "status": "success"}
            self._keep("pipeline_log.json", log)
            return Result(result, plan, checked, log, log["output_file"], {"encoded_data": encoded, "structure_analysis": analysis, "schema": schema})
        except Exception as e:
            log |= {"status": "failed", "error": str(e), "elapsed_seconds": round(time.time() - began, 2)}
            self._keep("pipeline_log.json", log)
            raise

    def _transform(self, table: DataFrame, analysis: pl.Analysis, schema: pl.Schema) -> tuple[DataFrame, Plan, Report, int]:
        """Plans, applies and validates until the result is valid; the last attempt stands as it is, a plan that fails is put aside for none."""
        plan = self.planner.plan(table, analysis, schema)
        for attempt in range(1, self.config.max_retries + 1):
            last = attempt == self.config.max_retries
            try:
                result = plan.apply(table)
                checked = validate(result, schema)
            except Exception:
                if last:
                    raise
                plan = Plan()
                continue
            if checked.is_valid or last:
                break
            plan = self.planner.repair(table, analysis, schema, plan, feedback(checked))
        return result, plan, checked, attempt

    def _keep(self, name: str, value: object) -> None:
        if self.config.save_intermediate:
            Path(self.config.output_dir).mkdir(parents=True, exist_ok=True)
            tables.write_json(str(Path(self.config.output_dir) / name), value)


def summary(result: Result) -> str:
    """A few lines on a run."""
    log = result.log
    lines = [f"Input: {log['input_file']}", f"Output: {log.get('output_file')}", f"Time: {log.get('elapsed_seconds')} s"]
    lines += [f"{stage}: " + ", ".join(f"{k}={v}" for k, v in entry.items() if k != "validation") for stage, entry in log["stages"].items()]
    lines.append(f"Valid: {result.validation.is_valid}")
    lines += [f"  {c.name}: {c.found}, wanted {c.wanted}; {c.advice}" for c in result.validation.failed]
    lines += [f"  {column}: {share} % nulls" for column, share in result.validation.mostly_null.items()]
    return "\n".join(lines)
