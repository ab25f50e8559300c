"""A small program language: op(a, b) steps whose arguments may be earlier results (#k), constants or table rows.

Parsing and execution run over Arrow batches: each distinct program and argument is read once a batch, and a step is
computed for all rows of a batch at once.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspark.functions.numbers import let, safe_double, shown, to_number
from lumenspark.functions.text import strip

STEPS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("op", "a1", "a2")]))
RESULTS = T.ArrayType(T.StructType([T.StructField("num", T.DoubleType()), T.StructField("txt", T.StringType())]))
TOLD = T.ArrayType(T.StructType([T.StructField("shown", T.StringType()), T.StructField("row", T.StringType()), T.StructField("values", T.ArrayType(T.DoubleType()))]))
RAN = T.StructType([T.StructField("steps", STEPS), *RESULTS.elementType.fields])
STORY = T.ArrayType(T.StructType([*STEPS.elementType.fields, *TOLD.elementType.fields]))
_STEP_TYPE = pa.list_(pa.struct([(c, pa.string()) for c in ("op", "a1", "a2")]))
_PAREN = re.compile(r"[()]")
_ARITHMETIC = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul, "divide": operator.truediv, "exp": np.power}
_OF_TABLE = {"table_max": max, "table_min": min, "table_sum": sum, "table_average": lambda v: sum(v) / len(v)}


def _steps(text: str | None) -> list[dict] | None:
    """The steps of one program. A step ends where the depth of parentheses is back at zero."""
    steps, begin, depth, opened = [], 0, 0, 0
    for m in _PAREN.finditer(text or ""):
        depth += 1 if m[0] == "(" else -1
        if depth < 0:
            return None
        if depth == 1 and m[0] == "(":
            opened = m.start()
        elif depth == 0:
            name = text[begin:opened].lstrip(" ,").strip()
            first, comma, last = text[opened + 1 : m.start()].rpartition(", ")
            if not comma or not name.isidentifier():
                return None
            steps.append({"op": name, "a1": first.strip(), "a2": last.strip()})
            begin = m.end()
    return steps if steps and depth == 0 and not text[begin:].strip(" ,") else None


# Programs of printable characters without nested parentheses, and one step of them up to its closing parenthesis.
_FLAT = r"^(?:[ ,]*[A-Za-z_][A-Za-z0-9_]* *\([ -'*-~]*, [ -'*-~]*\))+[ ,]*$"
_STEP = r"^[ ,]*(?P<op>[A-Za-z0-9_]+) *\((?P<a1>.*), (?P<a2>.*)$"


def _flat_steps(programs: pa.Array) -> pa.Array:
    """_steps() of programs that _FLAT describes, all at once."""
    parts = pc.split_pattern(programs, ")")
    ends = parts.offsets.to_numpy()
    inner = np.ones(len(parts.values), bool)
    inner[ends[1:] - 1] = False  # what follows the last step
    op, a1, a2 = pc.extract_regex(parts.values.filter(pa.array(inner)), _STEP).flatten()
    steps = pa.StructArray.from_arrays([op, pc.utf8_trim(a1, " "), pc.utf8_trim(a2, " ")], names=["op", "a1", "a2"])
    return pa.ListArray.from_arrays(pa.array(ends - np.arange(len(ends)), pa.int32()), steps)


def _parsed(programs: pa.Array) -> pa.Array:
    known = programs.dictionary_encode()
    texts = known.dictionary
    flat = pc.match_substring_regex(texts, _FLAT).to_numpy(zero_copy_only=False)
    if not flat.any():
        return pa.array([_steps(p) for p in texts.to_pylist()], _STEP_TYPE).take(known.indices)
    steps = _flat_steps(texts.filter(pa.array(flat)))
    if not flat.all():
        others = pa.array([_steps(p) for p in texts.filter(pa.array(~flat)).to_pylist()], _STEP_TYPE)
        place = np.where(flat, np.cumsum(flat) - 1, flat.sum() + np.cumsum(~flat) - 1)
        steps = pa.concat_arrays([steps.cast(_STEP_TYPE), others]).take(pa.array(place))
    return steps.take(known.indices).cast(_STEP_TYPE)


@F.arrow_udf(STEPS)
def _parse(programs: pa.Array) -> pa.Array:
    return _parsed(programs)


def parse(c: Column, deep: bool = False) -> Column:
    """Steps of a program, null if it isn't one. Parentheses nest to any depth; `deep` makes no difference any more."""
    return _parse(c)


def row_values(table: Column, name: Column) -> Column:
    """Numbers of the first row that `name` heads: a currency sign goes, a cell ends at a parenthesis; null if any isn't one."""
    row = F.get(F.filter(table, lambda r: strip(F.get(r, F.lit(0))) == strip(name)), F.lit(0))
    number = lambda x: to_number(strip(F.split_part(F.replace(x, F.lit("$"), F.lit("")), F.lit("("), F.lit(1))))
    values = let(row, lambda r: F.transform(F.when(F.size(r) > 1, F.slice(r, F.lit(2), F.size(r))), number))
    return let(values, lambda v: F.when((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v))


def _number(text: str) -> float:
    """What numbers.to_number() reads, NaN for none."""
    t = text.replace(",", "").strip()
    for spelled, scale in ((t, 1), (t.replace("%", ""), 100 if "%" in t else 0), ("-1" if t == "const_m1" else t[6:], 1 if t.startswith("const_") else 0)):
        if scale and spelled and not spelled.strip("0123456789.+-eE \t\n\r"):
            try:
                return float(spelled) / scale
            except ValueError:
                pass
    return np.nan


class _Tables:
    """The rows of a batch of tables by their heads. A row's numbers are read when a step first asks for them, and once."""

    def __init__(self, table: pa.Array):
        self.valid, self.rows = table.is_valid().to_numpy(zero_copy_only=False), table.offsets.to_numpy()
        inner = table.values
        self.at, self.cells, self.begin = inner.offsets.to_numpy(), inner.values, int(self.rows[0])
        low, high = self.at[self.begin : self.rows[-1]], self.at[self.begin + 1 : self.rows[-1] + 1]
        filled = (high > low) & inner.is_valid().to_numpy(zero_copy_only=False)[self.begin : self.rows[-1]]
        codes = self.cells.dictionary_encode()
        self.codes, self.texts, self.values = codes.indices, codes.dictionary, {}
        heads = np.full(len(low), None, object)
        heads[filled] = [(x or "").strip() for x in self.cells.take(pa.array(low[filled])).to_pylist()]
        self.heads, self.known = heads.tolist(), {}

    def numbers(self, table: int, head: str) -> list[float] | None:
        """Numbers of the first row of a table that has the head; None if there is none or any cell isn't a number."""
        if not self.valid[table]:
            return None
        try:
            i = self.heads.index(head, self.rows[table] - self.begin, self.rows[table + 1] - self.begin) + self.begin
        except ValueError:
            return None
        if i not in self.known:
            some = self.codes.slice(self.at[i] + 1, self.at[i + 1] - self.at[i] - 1).to_pylist()
            values = [self.value(x) for x in some]
            self.known[i] = values if values and all(v == v for v in values) else None
        return self.known[i]

    def value(self, code: int | None) -> float:
        """The number of a cell, read once for all cells that are spelled alike."""
        if code not in self.values:
            self.values[code] = np.nan if code is None else _number(self.texts[code].as_py().replace("$", "").partition("(")[0])
        return self.values[code]


def _arguments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Value of each argument (NaN for none), and the step that it refers to (-1 for none, -2 for a bad one)."""
    known = texts.dictionary_encode()
    names = known.dictionary
    plain = pc.match_substring_regex(names, r"^-?[0-9]{1,15}(\.[0-9]{1,15})?$")
    value = np.full(len(names) + 1, np.nan)
    value[:-1] = pc.fill_null(pc.if_else(plain, names, None).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    refers = np.full(len(names) + 1, -1)
    for i in np.flatnonzero(~plain.to_numpy(zero_copy_only=False)).tolist():
        a = names[i].as_py()
        if a[:1] == "#":
            refers[i] = int(a[1:]) if a[1:].isdecimal() and len(a) < 10 else -2
        else:
            value[i] = _number(a)
    at = known.indices.to_numpy()
    return value[at], refers[at]


def _run(steps: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[float]]]:
    """Steps of each program, which programs run, each step's number (NaN: none) and word (1: yes, 2: no), and the rows read."""
    sizes = pc.fill_null(pc.list_value_length(steps), 0).to_numpy()
    starts = np.cumsum(sizes) - sizes
    op, a1, a2 = steps.flatten().flatten()
    num, word, fine = np.full(len(op), np.nan), np.zeros(len(op), np.int8), np.ones(len(sizes), bool)
    read: dict[int, list[float]] = {}
    tables: _Tables | None = None
    names = op.dictionary_encode()
    kinds, kind = names.dictionary.to_pylist(), names.indices.to_numpy()
    sides = [_arguments(a) for a in (a1, a2)]
    for k in range(sizes.max(initial=0)):
        rows = np.flatnonzero(sizes > k)
        at = starts[rows] + k
        x, y = (np.where(to[at] == -1, value[at], np.where((to[at] >= 0) & (to[at] < k), num[starts[rows] + np.clip(to[at], 0, k)], np.nan)) for value, to in sides)
        for i in np.unique(kind[at]).tolist():
            name, here = kinds[i], np.flatnonzero(kind[at] == i)
            known = here[~(np.isnan(x[here]) | np.isnan(y[here]))]
            if name in _ARITHMETIC:
                with np.errstate(all="ignore"):
                    num[at[known]] = _ARITHMETIC[name](x[known], y[known])
            elif name == "greater":
                word[at[known]] = np.where(x[known] > y[known], 1, 2)
            elif name in _OF_TABLE:
                heads = a1.take(pa.array(at[here])).to_pylist()
                tables = tables or _Tables(table)
                for h, head in zip(here.tolist(), heads, strict=True):
                    values = tables.numbers(int(rows[h]), head)
                    if values:
                        num[at[h]], read[int(at[h])] = _OF_TABLE[name](values), values
        num[at] = np.where(np.isfinite(num[at]), num[at], np.nan)
        fine[rows] &= ~np.isnan(num[at]) | (word[at] > 0)
    return sizes, fine & steps.is_valid().to_numpy(zero_copy_only=False), num, word, read


def _lists(sizes: np.ndarray, fine: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs, one per step of the programs that run, null for the others."""
    offsets = np.concatenate([[0], np.cumsum(np.where(fine, sizes, 0))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)), mask=pa.array(~fine))


_WORDS = np.array([None, "yes", "no"], object)


def _worded(word: np.ndarray) -> pa.Array:
    return pa.array(["yes", "no"]).take(pa.array(word.astype(np.int8) - 1, mask=word == 0))


@F.arrow_udf(RESULTS)
def _execute(steps: pa.Array, table: pa.Array) -> pa.Array:
    sizes, fine, num, word, _ = _run(steps, table)
    keep = np.repeat(fine, sizes)
    return _lists(sizes, fine, {"num": pa.array(num[keep], mask=np.isnan(num[keep])), "txt": _worded(word[keep])})


@F.arrow_udf(RESULTS)
def _results(programs: pa.Array, table: pa.Array) -> pa.Array:
    sizes, fine, num, word, _ = _run(_parsed(programs), table)
    keep = np.repeat(fine, sizes)
    return _lists(sizes, fine, {"num": pa.array(num[keep], mask=np.isnan(num[keep])), "txt": _worded(word[keep])})


@F.arrow_udf(RAN)
def _ran(programs: pa.Array, table: pa.Array) -> pa.Array:
    steps = _parsed(programs)
    sizes, fine, num, word, _ = _run(steps, table)
    fine &= sizes > 0
    last = np.where(fine, np.cumsum(sizes) - 1, len(num))
    num, word = np.append(num, np.nan)[last], np.append(word, 0)[last]
    return pa.StructArray.from_arrays([steps, pa.array(num, mask=np.isnan(num)), _worded(word)], names=["steps", "num", "txt"])


def _told(steps: pa.Array, table: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    sizes, fine, num, word, read = _run(steps, table)
    at = np.flatnonzero(np.repeat(fine, sizes)).tolist()
    told = [_WORDS[w] or shown(v) for w, v in zip(word[at].tolist(), num[at].tolist(), strict=True)]
    rows = [", ".join(map(shown, read[i])) if i in read else None for i in at]
    return sizes, fine, {"shown": pa.array(told, pa.string()), "row": pa.array(rows, pa.string()), "values": pa.array([read.get(i) for i in at], pa.list_(pa.float64()))}


@F.arrow_udf(TOLD)
def _tell(steps: pa.Array, table: pa.Array) -> pa.Array:
    return _lists(*_told(steps, table))


@F.arrow_udf(STORY)
def _story(programs: pa.Array, table: pa.Array) -> pa.Array:
    steps = _parsed(programs)
    sizes, fine, told = _told(steps, table)
    keep = pa.array(np.repeat(fine, sizes))
    return _lists(sizes, fine, {n: x.filter(keep) for n, x in zip(("op", "a1", "a2"), steps.flatten().flatten(), strict=True)} | told)


def _needed(steps: Column, table: Column) -> Column:
    """Only programs with a table step need the table's cells."""
    return F.when(F.exists(steps, lambda s: s["op"].startswith("table_")), table)


def execute_steps(steps: Column, table: Column) -> Column:
    """Result of every step (num or txt), null if any step can't be executed."""
    return _execute(steps, _needed(steps, table))


def tell_steps(steps: Column, table: Column) -> Column:
    """Result of every step as text, and the values of the table row that it reads, null if any step can't be executed."""
    return _tell(steps, _needed(steps, table))


def results(program: Column, table: Column) -> Column:
    """execute_steps(parse(program), table) in one pass through Python."""
    return _results(program, F.when(program.contains("table_"), table))


def run(program: Column, table: Column) -> Column:
    """struct(steps, num, txt): the steps of a program and the result of the last, each null where there is none."""
    return _ran(program, F.when(program.contains("table_"), table))


def tell(program: Column, table: Column) -> Column:
    """Every step with its result as text and the table row that it reads, null if any step can't be executed."""
    return _story(program, F.when(program.contains("table_"), table))


def execute(program: Column, table: Column, deep: bool = False) -> Column:
    """struct(num, txt) of the last step, null if the program can't be executed."""
    ran = run(program, table)
    return F.when(ran["num"].isNotNull() | ran["txt"].isNotNull(), F.struct(ran["num"].alias("num"), ran["txt"].alias("txt")))


def literals(steps: Column) -> Column:
    """Absolute values of the number arguments as written, without a percent sign: no references, constants or row names."""
    args = F.flatten(F.transform(steps, lambda s: F.array(s["a1"], s["a2"])))
    plain = F.filter(args, lambda a: ~(a.startswith("#") | a.startswith("const_") | (a == "none")))
    bare = F.transform(plain, lambda a: F.when(a.contains("%"), F.regexp_replace(F.replace(a, F.lit(","), F.lit("")), "%+$", "")).otherwise(F.replace(a, F.lit(","), F.lit(""))))
    return F.array_compact(F.transform(bare, lambda a: F.abs(safe_double(a))))


def argument_set(steps: Column) -> Column:
    """Sorted distinct literals at 6 decimals: equal arrays are equal sets."""
    return F.array_sort(F.array_distinct(F.transform(literals(steps), lambda v: F.round(v, 6))))


def grounded(values: Column, available: Column) -> Column:
    """Every value is within 1e-9 + 1e-6 * a of some available number a."""
    return F.forall(values, lambda v: F.exists(available, lambda a: F.abs(v - a) <= 1e-9 + 1e-6 * a))


__all__ = ["parse", "row_values", "execute_steps", "tell_steps", "results", "run", "tell", "execute", "literals", "argument_set", "grounded", "safe_double"]
