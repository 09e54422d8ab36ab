"""Mathematical functions as Spark SQL text."""

from __future__ import annotations

import re

_SAME = {"ABS": "abs", "DEGREES": "degrees", "EXP": "exp", "LOG": "ln", "LOG10": "log10", "POWER": "pow", "RADIANS": "radians", "SQRT": "sqrt", "ACOS": "acos", "ASIN": "asin", "ATAN": "atan", "ATAN2": "atan2", "COS": "cos", "COT": "cot", "SIN": "sin", "TAN": "tan", "PI": "pi", "RAND": "rand", "ROUND": "round"}


def to_sql(name: str, args: list[str]) -> str:
    """MOD keeps the dividend's sign, ROUND rounds halves away from zero, TRUNCATE cuts towards zero, LOG of a number that is
    not positive is null."""
    match name:
        case "MOD":
            return f"({args[0]} % {args[1]})"
        case "CEILING" | "FLOOR":
            return f"CAST({'ceil' if name == 'CEILING' else 'floor'}({args[0]}) AS DOUBLE)"
        case "TRUNCATE" if len(args) > 1 and (digits := re.fullmatch(r"\(?(-?) ?(\d+)\)?", args[1])):
            # in decimals of the number's shortest text; what has no fraction in them is its own
            return f"CASE WHEN {args[0]} IS NULL THEN NULL ELSE coalesce(CAST(sign({args[0]}) * floor(try_cast(abs(CAST({args[0]} AS DOUBLE)) AS DECIMAL(38, 18)), {digits[1]}{digits[2]}) AS DOUBLE), CAST({args[0]} AS DOUBLE)) END"
        case "TRUNCATE":
            ten = f"pow(10D, {args[1]})" if len(args) > 1 else "1D"
            return f"(sign({args[0]}) * floor(abs({args[0]}) * {ten}) / {ten})"
        case "ROUND":
            return f"round(CAST({args[0]} AS DOUBLE), {args[1] if len(args) > 1 else 0})"
    return f"{_SAME[name]}({', '.join(args)})"
