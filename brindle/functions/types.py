"""Column types of the dialect and the exact reading of literals."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from ..errors import InvalidArgument, OutOfRange, Unsupported

#: Bits of the integer types, and the bounds of keys and dates.
INT_BITS = {"int8": 8, "int16": 16, "int32": 32, "int64": 64}
KEY_MAX = (1 << 40) - 1
DATE_MIN, DATE_MAX = dt.date(1900, 1, 1), dt.date(2999, 12, 31)
TEXT_MAX = 8144
_SPARK = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "bool": T.BooleanType(), "char": T.StringType(), "varchar": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType()}


@dataclass(frozen=True)
class Kind:
    """A declared type: ``name``, and precision and scale for decimals or a length for char."""

    name: str
    precision: int = 0
    scale: int = 0

    @property
    def is_int(self) -> bool:
        return self.name in INT_BITS

    @property
    def is_decimal(self) -> bool:
        return self.name == "decimal"

    @property
    def wide(self) -> bool:
        return self.is_decimal and self.precision > 18

    @property
    def is_text(self) -> bool:
        return self.name in ("char", "varchar")

    @property
    def family(self) -> str:
        """What a column may be compared with by column: the same family."""
        if self.is_int or self.name == "bool":
            return "int"
        return "text" if self.is_text else "decimal" if self.is_decimal else self.name

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.precision, self.scale) if self.is_decimal else _SPARK[self.name]

    def __str__(self) -> str:
        return f"decimal({self.precision},{self.scale})" if self.is_decimal else f"char({self.precision})" if self.name == "char" else self.name


def kind_of(name: str, args: list[int], column: str, byte: int) -> Kind:
    """The type written ``name`` or ``name(args)``; refusals carry the position."""
    name = name.lower()
    if name == "decimal128":
        name, args = "decimal", args or [38, 0]
    if name == "decimal":
        if len(args) != 2:
            raise InvalidArgument(f"column '{column}' needs a precision and a scale - decimal(p, s)", byte)
        p, s = args
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise InvalidArgument(f"decimal({p}, {s}) is out of range", byte)
        return Kind("decimal", p, s)
    if name == "char":
        return Kind("char", args[0] if args else 1)
    if name == "float":
        raise Unsupported("float columns have no exact encoding", byte)
    if name not in _SPARK or args:
        raise InvalidArgument(f"unknown type '{name}'", byte)
    return Kind(name)


def kind_from_spark(t: T.DataType) -> Kind:
    """The declared type that a Spark column is registered as; doubles become exact decimals."""
    if isinstance(t, T.DecimalType):
        return Kind("uint64") if (t.precision, t.scale) == (20, 0) else Kind("decimal", t.precision, t.scale)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return Kind("decimal", 15, 2)
    if isinstance(t, T.TimestampType):
        return Kind("timestamp")
    for name, spark in _SPARK.items():
        if spark == t and name not in ("char", "uint64"):
            return Kind(name)
    raise Unsupported(f"no column type for {t.simpleString()}")


def read_decimal(text: str, kind: Kind, byte: int | None) -> Decimal:
    """A decimal literal at its column's scale: never rounded, never beyond the precision."""
    m = re.fullmatch(r"([+-]?)([0-9]+)(?:\.([0-9]+))?", text)
    if not m:
        raise InvalidArgument(f"'{text}' is not a decimal", byte)
    if len(m[3] or "") > kind.scale:
        raise InvalidArgument(f"'{text}' has more than {kind.scale} digits after the point", byte)
    if len((m[2] + (m[3] or "").ljust(kind.scale, "0")).lstrip("0")) > kind.precision:
        raise OutOfRange(f"'{text}' does not fit {kind}", byte)
    return Decimal(f"{m[1]}{m[2]}.{(m[3] or '').ljust(kind.scale, '0')}")  # no context, so no rounding


def read_date(text: str, byte: int | None) -> dt.date:
    if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise InvalidArgument(f"'{text}' is not a date (YYYY-MM-DD)", byte)
    try:
        value = dt.date.fromisoformat(text)
    except ValueError:
        raise InvalidArgument(f"'{text}' is not a date (YYYY-MM-DD)", byte) from None
    if not DATE_MIN <= value <= DATE_MAX:
        raise OutOfRange(f"date '{text}' is outside {DATE_MIN}..{DATE_MAX}", byte)
    return value


def read_timestamp(text: str, byte: int | None) -> dt.datetime:
    m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]{1,6}))?", text)
    if not m:
        raise InvalidArgument(f"'{text}' is not a timestamp (YYYY-MM-DD HH:MM:SS[.ffffff])", byte)
    day = read_date(m[1], byte)
    try:
        return dt.datetime(day.year, day.month, day.day, int(m[2]), int(m[3]), int(m[4]), int((m[5] or "0").ljust(6, "0")))
    except ValueError:
        raise InvalidArgument(f"'{text}' is not a timestamp", byte) from None


#: What ``coerce`` gives where no value of the column can equal, or be compared with, the literal.
MISMATCH = object()


def coerce(value, quoted: bool, kind: Kind, byte: int | None = None):
    """A literal as its column's Python value; MISMATCH if the kinds can't be compared; an error if it is badly spelled.

    ``quoted``: written as a string, or as a bare number with a point, which is the same.
    """
    if value is None:
        return None
    if kind.is_int or kind.name == "bool":
        if quoted:
            return MISMATCH
        if kind.name == "bool":
            if value not in (0, 1):
                raise InvalidArgument("a bool is written 0 or 1", byte)
            return bool(value)
        if not -(1 << 63) <= value < 1 << 63:
            raise OutOfRange(f"{value} does not fit int64", byte)
        return value
    if kind.name == "uint64":
        if quoted:
            return MISMATCH
        if not 0 <= value < 1 << 64:
            raise OutOfRange(f"{value} does not fit uint64", byte)
        return Decimal(value)
    if kind.is_decimal:
        return read_decimal(str(value), kind, byte)
    if not quoted:
        if kind.is_text:
            return MISMATCH
        raise InvalidArgument(f"a {kind} literal is quoted", byte)
    if kind.name == "date":
        return read_date(value, byte)
    return read_timestamp(value, byte) if kind.name == "timestamp" else value


def stored(value, quoted: bool, kind: Kind, column: str, byte: int | None = None):
    """A literal as a value to store: as ``coerce``, but mismatches and values that don't fit are errors."""
    got = coerce(value, quoted, kind, byte)
    if got is MISMATCH:
        raise InvalidArgument(f"column '{column}' is {kind}", byte)
    if kind.is_int and got is not None and not -(1 << INT_BITS[kind.name] - 1) <= got < 1 << INT_BITS[kind.name] - 1:
        raise InvalidArgument(f"{got} does not fit column '{column}' ({kind})", byte)
    if kind.is_text and got is not None:
        n = len(got.encode())
        if kind.name == "char" and n > kind.precision:
            raise InvalidArgument(f"column '{column}' holds {kind.precision} bytes", byte)
        if n > TEXT_MAX:
            raise Unsupported(f"a value may not be longer than {TEXT_MAX} bytes", byte)
    return got


def render(value) -> str:
    """A value as a text reply shows it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S") + (f".{value.microsecond:06d}" if value.microsecond else "")
    return str(value)
