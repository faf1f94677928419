"""Reading tables, checking them, and writing result tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.expressions import col
from plumbline.functions.lexicon import MISSING_MARKERS
from plumbline.functions.storage import stored
from plumbline.operators.clean import nullify_nan


def read_table(
    spark: SparkSession,
    source: str | DataFrame,
    schema: T.StructType | str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """A CSV file or folder, a Parquet file or folder, or an existing DataFrame.

    CSV cells that hold a missing marker become null and column types follow
    from the remaining values, or from ``schema``, which saves the pass over the
    data. Files that are not valid UTF-8 are read as ISO-8859-1. Quoted cells may
    span lines, wherever a file is split; ``multiline=False`` says that none does, which saves the pass that looks for them.
    """
    if isinstance(source, DataFrame):
        return nullify_nan(source)
    lowered = source.lower().rstrip("/")
    if not lowered.endswith((".csv", ".parquet")):
        raise ValueError(f"not a CSV or Parquet table: {source}")
    try:
        if lowered.endswith(".parquet"):
            return nullify_nan(spark.read.parquet(source))
        return nullify_nan(_typed(_cells(spark, source, multiline), schema))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(source) from error
        raise


# Cells as the parser takes them: a quote opens a cell only where the cell begins; after the closing one everything up to the
# next comma still belongs to the cell. Possessive, so that long cells need no stack.
_QUOTED = r'"(?:[^"]++|"")*+"[^,]*+'
_CELL = rf'(?:{_QUOTED}|(?!")[^,]*+)'
_OPEN = r'"(?:[^"]++|"")*+'
# A line that begins outside of a quoted cell and ends inside one; the same for lines that begin inside one.
OPENS = re.compile(rf"(?:{_CELL},)*+{_OPEN}", re.S)
STAYS = re.compile(r'(?:[^"]++|"")*+', re.S)
REOPENS = re.compile(rf'(?:[^"]++|"")*+"[^,]*+,(?:{_CELL},)*+{_OPEN}', re.S)
SPLIT = ["file", "start"]


def _ends_inside(line: str, inside: bool) -> bool:
    if '"' not in line:
        return inside
    if inside:
        return bool(STAYS.fullmatch(line) or REOPENS.fullmatch(line))
    return bool(OPENS.fullmatch(line))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in (*SPLIT, "line")))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: whether it is valid UTF-8, whether it ends inside a quoted cell if it begins outside of one and if it
    begins inside of one, and whether the record that is open at its beginning ends in it."""
    found: dict[tuple[str, int], list[bool]] = {}
    for file, start, line in _lines(batches):
        state = found.setdefault((file, start), [True, False, True, False])
        state[0] = state[0] and _is_utf8(line)
        if b'"' in line:
            text = line.decode("latin-1")  # quotes and commas are the same bytes in all the encodings
            state[1], state[2] = _ends_inside(text, state[1]), _ends_inside(text, state[2])
            state[3] = state[3] or not state[2]
    if found:
        names = ("valid", "outside", "inside", "closes")
        yield pa.RecordBatch.from_pylist([{"file": f, "start": s} | dict(zip(names, state)) for (f, s), state in found.items()])


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode()
    except UnicodeDecodeError:
        return False
    return True


def _records(begins: dict[tuple[str, int], tuple[bool, int]], firsts: set[tuple[str, int]], encoding: str, multiline: bool):
    """Records of a split. Those that began in an earlier split, or go on in the next, are pieces to be joined; ``begins`` tells whether a
    split begins inside of a record, and in which split that record began."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, open_lines, inside, owner, header = None, [], False, None, False

        def close(whole: bool) -> None:
            nonlocal open_lines, owner, header
            if open_lines:
                # The first record of a file is its header.
                text = "\n".join(open_lines)
                if whole and owner is None:
                    if not header:
                        out.append((text, None, None, None))
                else:
                    origin = owner or at
                    out.append((text, *origin, at[1]))
                header = False
            open_lines, owner = [], None

        for file, start, line in _lines(batches):
            if (file, start) != at:
                close(whole=not inside)
                at = (file, start)
                inside, origin = begins[at]
                owner = (file, origin) if inside else None
                header = at in firsts
            text = line.decode(encoding)
            open_lines.append(text)
            inside = multiline and _ends_inside(text, inside)
            if not inside:
                close(whole=True)
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        close(whole=not inside)
        if out:
            yield _batch(out)

    return make


RECORD = "record string, file string, origin long, start long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=kind) for values, kind in zip(zip(*rows), kinds)], ["record", "file", "origin", "start"]
    )


def _cells(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """Every cell as text, missing markers as null, parsed once and stored.

    Each split of a file is read by one task, whatever quotes it holds: a first pass finds out how a split leaves a quoted cell that it
    finds open, or closed, at its start; from these facts, a row per split, follows where each split stands. The second pass
    makes records, and the pieces of those that cross a border are joined.
    """
    options = {"quote": '"', "escape": '"'}
    names = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, encoding="ISO-8859-1", **options).columns
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line")
    )
    schema = "file string, start long, valid boolean, outside boolean, inside boolean, closes boolean"
    facts = lines.mapInArrow(_splits, schema).orderBy(*SPLIT).collect()
    encoding = "utf-8" if all(f["valid"] for f in facts) else "latin-1"
    if encoding == "utf-8":
        try:
            names = [n.encode("latin-1").decode() for n in names]
        except UnicodeError:
            pass
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    firsts: set[tuple[str, int]] = set()
    file, inside, origin = None, False, 0
    for f in facts:
        if f["file"] != file:
            file, inside = f["file"], False
            firsts.add((file, f["start"]))
        begins[file, f["start"]] = (inside, origin)
        goes_on = inside and not f["closes"]
        inside = multiline and (goes_on or (f["inside"] if inside else f["outside"]))
        origin = origin if goes_on else f["start"]
    made = lines.mapInArrow(_records(begins, firsts, encoding, multiline), RECORD)
    whole = made.where("file IS NULL").select("record")
    glued = (
        made.where("file IS NOT NULL").groupBy("file", "origin")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n").alias("record"))
        .select("record")
    )
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    parsed = whole.unionByName(glued).where(F.length(F.trim("record")) > 0).select(F.from_csv("record", schema, options).alias("r"))
    cells = [F.when(~F.col(f"r.c{i}").isin(MISSING_MARKERS), F.col(f"r.c{i}")).alias(n) for i, n in enumerate(names)]
    return stored(parsed.select(*cells))


# Narrowest type first. A column takes the first type that all its values fit.
def _candidates(cell: Column) -> dict[str, Column]:
    trimmed = F.trim(cell)
    whole = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed)
    decimal = F.when(
        F.lower(trimmed).rlike(r"^[+-]?(\d+\.?\d*([e][+-]?\d+)?|\.\d+([e][+-]?\d+)?|inf|infinity)$"), trimmed
    )
    return {
        "bigint": whole.try_cast("bigint"),
        "double": F.regexp_replace(F.lower(decimal), "inf(inity)?$", "Infinity").try_cast("double"),
        "boolean": F.when(F.lower(trimmed).isin("true", "false"), trimmed).try_cast("boolean"),
        "date": F.when(cell.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), cell).try_cast("date"),
        "timestamp": F.when(cell.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d.*$"), cell).try_cast("timestamp"),
    }


def _typed(text: DataFrame, schema: T.StructType | str | None) -> DataFrame:
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        return text.select(*[col(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
    options = {c: _candidates(col(c)) for c in text.columns}
    # One scan counts the values and, per type, those that fit it.
    counts = text.agg(
        *[
            e
            for i, c in enumerate(text.columns)
            for e in (
                F.count(col(c)).alias(f"n{i}"),
                *[F.count(fit).alias(f"{name}{i}") for name, fit in options[c].items()],
            )
        ]
    ).first()
    typed = []
    for i, c in enumerate(text.columns):
        fits = [name for name in options[c] if counts[f"n{i}"] and counts[f"{name}{i}"] == counts[f"n{i}"]]
        typed.append((options[c][fits[0]] if fits else col(c)).alias(c))
    return text.select(*typed)


def validate(df: DataFrame) -> DataFrame:
    """The table itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def _json_safe(df: DataFrame) -> DataFrame:
    """Dates and timestamps as yyyy-MM-dd."""
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            F.date_format(col(f.name), "yyyy-MM-dd").alias(f.name)
            if isinstance(f.dataType, dated) else col(f.name)
            for f in df.schema
        ]
    )


def write_findings(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Write a result table; as JSON, dates are written yyyy-MM-dd and nulls are kept."""
    if fmt == "json":
        _json_safe(df).write.mode(mode).json(path, ignoreNullFields=False)
    else:
        df.write.mode(mode).format(fmt).save(path)


def as_json(df: DataFrame) -> DataFrame:
    """(json): one JSON object per row."""
    safe = _json_safe(df)
    return safe.select(F.to_json(F.struct(*[col(c) for c in safe.columns]), {"ignoreNullFields": "false"}).alias("json"))
