"""Column expressions as SQL text that `F.expr` reads back."""

from __future__ import annotations

from pyspark.sql import Column


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(node) -> str:
    value, kind = node.value(), node.dataType()
    type_name = kind.get().sql() if kind.isDefined() else None
    if value is None:
        return f"CAST(NULL AS {type_name})" if type_name and type_name != "VOID" else "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, int):
        return f"CAST({_text(str(value))} AS {type_name or ('INT' if -(1 << 31) <= value < 1 << 31 else 'BIGINT')})"
    if isinstance(value, float):
        return f"CAST({_text(repr(value))} AS {type_name or 'DOUBLE'})"
    kinds = {"java.sql.Date": "DATE", "java.time.LocalDate": "DATE", "java.time.LocalDateTime": "TIMESTAMP_NTZ", "java.math.BigDecimal": None}
    name = value.getClass().getName() if hasattr(value, "getClass") else type(value).__name__
    if type_name or kinds.get(name):
        return f"CAST({_text(str(value.toString() if hasattr(value, 'toString') else value))} AS {type_name or kinds[name]})"
    if name == "Decimal":
        return f"CAST('{value}' AS DECIMAL({max(len(value.as_tuple().digits), -value.as_tuple().exponent)},{-value.as_tuple().exponent}))"
    raise ValueError(f"a literal of {name} has no SQL text")


def _node(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedAttribute":
        return ".".join(_quoted(p) for p in _items(node.nameParts()))
    if kind == "Literal":
        return _literal(node)
    if kind == "UnresolvedFunction":
        args = _items(node.arguments())
        # Only a plain name may have named arguments (struct); operators need quotes.
        name = node.functionName() if any(a.getClass().getSimpleName() == "Alias" for a in args) else _quoted(node.functionName())
        return f"{name}({'DISTINCT ' if node.isDistinct() else ''}{', '.join(map(_node, args))})"
    if kind == "Alias":
        names = _items(node.name())
        if len(names) != 1:
            raise ValueError("several names for one expression have no SQL text")
        return f"{_node(node.child())} AS {_quoted(names[0])}"
    if kind == "Cast":
        lenient = node.evalMode().isDefined() and "TRY" in node.evalMode().get().toString().upper()
        return f"{'TRY_CAST' if lenient else 'CAST'}({_node(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        whens = " ".join(f"WHEN {_node(b._1())} THEN {_node(b._2())}" for b in _items(node.branches()))
        other = f" ELSE {_node(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE {whens}{other} END"
    if kind == "UnresolvedExtractValue":
        return f"{_node(node.child())}[{_node(node.extraction())}]"
    if kind == "LambdaFunction":
        names = [_node(a) for a in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_node(node.function())}"
    if kind == "UnresolvedNamedLambdaVariable":
        return _quoted(node.name())
    if kind == "SqlExpression":
        return node.expression()
    raise ValueError(f"{kind} has no SQL text here: {node.sql()}")


def sql_of(col: Column) -> str:
    """SQL of a column expression. An error for what has none, such as Python functions and windows."""
    return _node(col._jc.node())


def described(col: Column) -> str:
    """What a version says of an expression: its SQL, or the planner's text where it has none."""
    try:
        return sql_of(col)
    except ValueError:
        return str(col)
