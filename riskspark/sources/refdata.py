"""Reference tables of the payment model.

The tables hold at most a few hundred rows by nature (one row per model variable), so
they are read to the driver once, checked against a bound, and turned into literal
arrays. A plan then looks a variable up by position instead of joining.
"""

from __future__ import annotations

import csv
import io
import json
from dataclasses import dataclass, field
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.sources import fixed_values as fv

#: A reference table with more rows than this is a wrong file, not a model.
MAX_REFERENCE_ROWS = 5_000
#: Coefficients are kept as whole numbers of this unit, so sums are exact.
UNITS = 1_000_000

TABLE_FILES = {
    "hierarchies": "hierarchies.csv",
    "groups": "groups.csv",
    "interactions": "interactions.csv",
    "ce_factors": "ce_factors.csv",
    "ne_factors": "ne_factors.csv",
}


def int_array(values: list) -> str:
    """SQL text of a constant array: one literal that Catalyst folds, whatever its length."""
    depth = "array<array<int>>" if values and isinstance(values[0], list) else "array<bigint>"
    return f"from_json('{json.dumps(values, separators=(',', ':'))}', '{depth}')"


def text_array(values: list[str]) -> str:
    quoted = json.dumps(values).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{quoted}', 'array<string>')"


def category_name(text: str) -> str:
    """``HCC18.0`` and ``HCC18`` name the same category; ``8_5`` reads as 8.5."""
    suffix = text.strip().removeprefix("HCC").replace("_", ".")
    try:
        number = Decimal(suffix)
    except ArithmeticError:
        return f"HCC{suffix}"
    if number == number.to_integral_value():
        return f"HCC{int(number)}"
    return "HCC" + format(number.normalize(), "f").replace(".", "_")


def local_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small constant table, planned as one folded literal (no task ships rows)."""
    quoted = json.dumps(rows).replace("\\", "\\\\").replace("'", "\\'")
    return spark.sql(f"SELECT inline(from_json('{quoted}', 'array<struct<{schema}>>'))")


@dataclass(frozen=True)
class RefData:
    """Parsed tables. ``variables`` fixes the position (from 1) of every variable."""

    hierarchy: list[tuple[str, list[str]]]
    groups: list[tuple[str, list[str]]]
    interactions: list[tuple[str, str, str]]
    factors: dict[str, dict[str, Decimal]]
    labels: dict[str, str]
    ce_models: list[str]
    ne_models: list[str]
    variables: list[str] = field(default_factory=list)

    @property
    def models(self) -> list[str]:
        return self.ce_models + self.ne_models

    @property
    def domain(self) -> list[str]:
        return [hcc for hcc, _ in self.hierarchy]

    def position(self, variable: str) -> int:
        return self._positions()[variable]

    def _positions(self) -> dict[str, int]:
        return {v: i for i, v in enumerate(self.variables, start=1)}

    # constant arrays as SQL text, indexed by variable position --------------------
    def names(self) -> str:
        return text_array(self.variables)

    def label_array(self) -> str:
        return text_array([self.labels.get(v, "") for v in self.variables])

    def coefficients(self, model: str) -> str:
        return int_array([int(self.factors.get(v, {}).get(model, 0) * UNITS) for v in self.variables])

    def suppressed_by(self) -> str:
        pos, below = self._positions(), dict(self.hierarchy)
        return int_array([[pos[x] for x in below.get(v, []) if x in below] for v in self.variables])

    def groups_of(self) -> str:
        pos = self._positions()
        return int_array([[pos[g] for g, members in self.groups if v in members] for v in self.variables])

    def position_of_cc(self) -> str:
        """Position of the category with number ``i`` at index ``i``; 0 outside the domain."""
        pos = {int(h[3:]): self.position(h) for h in self.domain if h[3:].isdigit()}
        return int_array([pos.get(i, 0) for i in range(max(pos) + 1)])

    # tables ----------------------------------------------------------------------
    def hierarchy_table(self, spark: SparkSession) -> DataFrame:
        pos = self._positions()
        rows = [
            {"hcc": h, "suppressed": x, "hcc_pos": pos[h], "suppressed_pos": pos[x]}
            for h, below in self.hierarchy
            for x in below
            if x in self.domain
        ]
        return local_table(spark, rows, "hcc:string,suppressed:string,hcc_pos:int,suppressed_pos:int")

    def factor_table(self, spark: SparkSession) -> DataFrame:
        """Long form: one row per variable and model that has a coefficient."""
        pos = self._positions()
        rows = [
            {"variable": v, "variable_pos": pos[v], "model": m, "coef": str(c), "label": self.labels.get(v, "")}
            for v, by_model in self.factors.items()
            for m, c in by_model.items()
        ]
        table = local_table(spark, rows, "variable:string,variable_pos:int,model:string,coef:string,label:string")
        return table.withColumn("coef", table.coef.cast("decimal(12,6)"))


def _bounded_csv(spark: SparkSession, path: str) -> list[list[str]]:
    """Rows of a small CSV file, header first; refuses a file above the bound."""
    df = spark.read.option("header", True).csv(path)
    rows = df.limit(MAX_REFERENCE_ROWS + 1).collect()
    if len(rows) > MAX_REFERENCE_ROWS:
        raise ValueError(f"{path}: more than {MAX_REFERENCE_ROWS} rows is not a reference table")
    return [df.columns] + [["" if v is None else str(v) for v in r] for r in rows]


def _text_csv(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text)))


def _coefficient(text: str) -> Decimal:
    """Scores add up whole millionths, so a finer coefficient is refused rather than cut."""
    value = Decimal(text)
    if value != round(value, 6):
        raise ValueError(f"coefficient {text}: more than six decimals")
    return value


def _parse(tables: dict[str, list[list[str]]]) -> RefData:
    def body(name: str) -> list[list[str]]:
        return [[c.strip() for c in row] for row in tables[name][1:] if row and row[0].strip()]

    hierarchy = [(category_name(r[0]), [category_name(x) for x in r[1:] if x]) for r in body("hierarchies")]
    groups = [(r[0], [x for x in r[1:] if x]) for r in body("groups")]
    interactions = [(r[0], r[1], r[2]) for r in body("interactions")]

    factors: dict[str, dict[str, Decimal]] = {}
    labels: dict[str, str] = {}
    models: dict[str, list[str]] = {}
    for name, known in (("ce_factors", fv.CE_MODELS), ("ne_factors", fv.NE_MODELS)):
        header = [c.strip() for c in tables[name][0]]
        text_columns = 2 if header[1] not in known else 1
        models[name] = header[text_columns:]
        for row in body(name):
            if name == "ce_factors":
                labels[row[0]] = row[1].strip().strip('"')
            values = row[text_columns:]
            factors[row[0]] = {m: _coefficient(v) for m, v in zip(models[name], values) if v}

    variables = list(
        dict.fromkeys(
            [*factors, *(h for h, _ in hierarchy), *(g for g, _ in groups), *(i for i, _, _ in interactions),
             *(v for _, a, b in interactions for v in (a, b)), "DISABL"]
        )
    )
    return RefData(hierarchy, groups, interactions, factors, labels, models["ce_factors"], models["ne_factors"], variables)


@lru_cache(maxsize=1)
def builtin_refdata() -> RefData:
    return _parse(
        {
            "hierarchies": _text_csv(fv.HIERARCHIES),
            "groups": _text_csv(fv.DIAGNOSIS_GROUPS),
            "interactions": _text_csv(fv.INTERACTIONS),
            "ce_factors": _text_csv(fv.CE_FACTORS),
            "ne_factors": _text_csv(fv.NE_FACTORS),
        }
    )


def find_tables(spark: SparkSession, ref_dir: str) -> dict[str, str]:
    """Table name → the CSV file, or folder of part files, below ``ref_dir`` that has the table's columns.

    File names don't matter, nor in which folder below a file stands. Only first lines are read.
    A table that two files offer is an error, as is one that none offers.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ref_dir)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    paths = set()
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().lower().endswith(".csv"):
            paths.add((path.getParent() if path.getName().startswith("part-") else path).toString())
    offers: dict[str, list[str]] = {t: [] for t in TABLE_FILES}
    for path in sorted(paths):
        columns = {c.strip().lstrip("\ufeff").lower() for c in spark.read.option("header", True).csv(path).columns}
        for name in TABLE_FILES:
            if fv.TABLE_COLUMNS[name] <= columns:
                offers[name].append(path)
    for name, found in offers.items():
        if len(found) != 1:
            raise ValueError(f"{ref_dir}: {'no file' if not found else ' and '.join(found)} for the table {name}")
    return {name: found[0] for name, found in offers.items()}


def load_refdata(spark: SparkSession, ref_dir: str | None = None, files: dict[str, str] | None = None) -> RefData:
    """The built-in tables, or those of ``ref_dir`` (or ``spark.riskspark.ref.dir``).

    Files are known by their columns (``find_tables``), whatever their names. With ``files``
    (table name → path below ``ref_dir``) they are known by path, those left out as in ``TABLE_FILES``.
    """
    ref_dir = ref_dir or spark.conf.get("spark.riskspark.ref.dir", None)
    if not ref_dir:
        return builtin_refdata()
    if files:
        paths = {t: f"{ref_dir.rstrip('/')}/{f}" for t, f in {**TABLE_FILES, **files}.items()}
    else:
        paths = find_tables(spark, ref_dir)
    return _parse({t: _bounded_csv(spark, path) for t, path in paths.items()})


def in_file_order(rows: DataFrame) -> DataFrame:
    """``rows`` of a file scan with ``load_order``: by path, then by place in the file."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.withColumn("load_order", place)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Code→category map as text columns with ``load_order``; typed later by ``prepare_code_map``."""
    return in_file_order(spark.read.option("header", True).csv(path))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """First two columns of a description file, by position.

    Preamble and header lines need no counting: they carry no known code, so the join
    with the code map leaves them out.
    """
    return in_file_order(spark.read.csv(path, schema="icd10 string, description string"))
