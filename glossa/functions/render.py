"""Small results as Markdown or LaTeX tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def cell(value, places: int = 3) -> str:
    if value is None:
        return "--"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.{places}f}"
    return f"{value:,}" if isinstance(value, int) else str(value)


def to_markdown(df: DataFrame, caption: str | None = None, places: int = 3, most: int = 1000) -> str:
    """At most `most` rows; a larger result is an error, as a report is meant to be read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    body = [[cell(v, places).replace("|", "\\|") for v in r] for r in rows]
    widths = [max(map(len, column)) for column in zip(df.columns, *body, strict=True)]
    line = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    head = [f"**{caption}**", ""] if caption else []
    return "\n".join([*head, line(df.columns), "|" + "|".join("-" * (w + 2) for w in widths) + "|", *map(line, body)]) + "\n"


def to_latex(df: DataFrame, caption: str, label: str, places: int = 3, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    clean = lambda s: "".join({"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}.get(c, c) for c in s)
    line = lambda cells: " & ".join(map(clean, cells)) + r" \\"
    form = "".join("l" if kind == "string" else "r" for _, kind in df.dtypes)
    return "\n".join([r"\begin{table}", rf"\caption{{{clean(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{form}}}", r"\toprule", line(df.columns), r"\midrule", *(line([cell(v, places) for v in r]) for r in rows), r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"


def confusion_to_latex(df: DataFrame, caption: str, label: str, most: int = 60) -> str:
    """A shaded table of df (true, pred, share): a cell's share in percent on a blue of that strength, "--" where none is."""
    rows = df.select("true", "pred", "share").limit(most * most + 1).collect()
    names = sorted({r["true"] for r in rows} | {r["pred"] for r in rows})
    if len(names) > most:
        raise ValueError(f"over {most} labels")
    share = {(r["true"], r["pred"]): r["share"] for r in rows}
    clean = lambda x: x.replace("_", r"\_")

    def one(pair):
        v = share.get(pair)
        return "--" if v is None else rf"\cellcolor{{blue!{round(60 * v)}}}{100 * v:.1f}"

    body = [" & ".join([clean(t), *(one((t, p)) for p in names)]) + r" \\" for t in names]
    head = " & ".join(["", *map(clean, names)]) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{caption}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{l{'r' * len(names)}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]) + "\n"
