"""Changes between versions of a text, pages, and logs of agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careerlake.functions import dims
from careerlake.functions.text import percent, squeezed
from careerlake.operators.match import lexicon_skills

NUMBER = r"(^|[^A-Za-z0-9_])(\d[\d,.]*\+?%?)"


def normal_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: squeezed(x)), lambda x: x != "")


def line_changes(before: Column, after: Column) -> Column:
    """changed, total, pct: lines, repeats included, that the old text doesn't have; deletions don't count."""
    now = normal_lines(after)
    # the old lines are bound to a variable, else each new line would split the old text anew
    new = F.flatten(F.transform(F.array(normal_lines(before)), lambda old: F.filter(now, lambda x: ~F.array_contains(old, x))))
    return F.struct(F.size(new).cast("long").alias("changed"), F.size(now).cast("long").alias("total"), percent(F.size(new), F.size(now)).alias("pct"))


def numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(2)), lambda x: F.regexp_replace(x, "[,.]+$", "")))


def unsupported(original: Column, output: Column, lexicon: tuple[str, ...]) -> Column:
    """Skills and numbers of the new text that the original doesn't have."""
    skills = F.array_except(lexicon_skills(output, lexicon), lexicon_skills(original, lexicon))
    found = F.array_except(numbers(output), numbers(original))
    return F.concat(F.transform(skills, lambda s: F.concat(F.lit('skill "'), s, F.lit('"'))), F.transform(found, lambda s: F.concat(F.lit('number "'), s, F.lit('"'))))


def page_text(html: Column) -> dict[str, Column]:
    """Title, description and visible text; &amp; is decoded before the others, as it always was."""
    title = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    one = F.regexp_extract(html, r"""(?i)<meta[^>]+name=["']description["'][^>]+content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(html, r"""(?i)<meta[^>]+content=["']([^"']*)["'][^>]+name=["']description["']""", 1)
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg).*?</\1>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for code, c in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(code), F.lit(c))
    return {"title": title, "description": F.trim(F.coalesce(F.nullif(one, F.lit("")), two)), "text": F.trim(F.regexp_replace(text, r"\s+", " "))}


def public_url(url: Column) -> Column:
    """Plain web address of a named public host: no user, no odd port, no numeric or internal host."""
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host, port = F.lower(F.regexp_extract(authority, r"^([^:\[\]@]*)(?::(\d*))?$", 1)), F.regexp_extract(authority, r"^([^:\[\]@]*)(?::(\d*))?$", 2)
    inner = host.rlike(r"(^|\.)(localhost|local|internal|lan|home|corp)$")
    ok = scheme.isin("http", "https") & ~F.contains(authority, F.lit("@")) & port.isin("", "80", "443") & F.contains(host, F.lit(".")) & ~host.rlike(r"^[0-9.]+$") & ~inner
    return F.coalesce(ok, F.lit(False))


def merged_notes(notes: Column, missing: Column) -> Column:
    """Missing skills that no note mentions are added."""
    return F.concat(notes, F.filter(missing, lambda m: ~F.exists(notes, lambda n: F.contains(F.lower(n), F.lower(m)))))


def confidence(kind: Column, stated: Column, page_read: Column) -> Column:
    """High is too sure without a page; an unknown kind is low."""
    return F.when(kind.isNull(), "low").when((stated == "high") & ~page_read, "medium").otherwise(stated)


def with_caveats(notes: Column, sources: Column) -> Column:
    """A note for each unverified source, unless one begins alike."""
    made = F.transform(F.filter(sources, lambda s: s.isin("sample", "model_estimate")), lambda s: F.concat(F.lit("Not verified: source "), s))
    return F.concat(notes, F.filter(made, lambda m: ~F.exists(notes, lambda n: F.substring(n, 1, 18) == F.substring(m, 1, 18))))


def accepted_steps(steps: DataFrame, most: int = 8) -> DataFrame:
    """Steps of runs with `kind`: a repeat of a call that was ok is a duplicate; steps beyond the cap go."""
    w = Window.partitionBy("run_id", "tool", "args").orderBy("step")
    before = F.max(F.when(F.col("ok"), 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = steps.withColumn("kind", F.when(before == 1, "duplicate").when(F.col("ok"), "ok").otherwise("error"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("step"))).filter(F.col("place") <= most)


def clipped(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def json_in(text: Column) -> Column:
    """The JSON object in a model's answer: thoughts and code fences go, then from the first brace to the last."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def preselected(kind: Column, sure: Column) -> Column:
    """The option that stands for a kind of company, unless it is a mere guess."""
    known = F.create_map(*(F.lit(x) for pair in dims.COMPANY_OPTIONS.items() for x in pair))
    return F.when(sure != "low", F.try_element_at(known, kind))


def request_faults(fields: dict[str, Column], phase: Column) -> Column:
    """Names of the fields of a request that are too short or too long (the user name may be missing), and `phase` if it is none of the known."""
    faults = []
    for name, value in fields.items():
        least, most = dims.REQUEST_LENGTHS[name]
        ok = F.length(value).between(least, most)
        faults.append(F.when(~F.coalesce(ok, F.lit(least == 0)), name))
    return F.array_compact(F.array(*faults, F.when(~F.coalesce(phase.isin(*dims.PHASES), F.lit(False)), "phase")))


def decision(answer: Column) -> dict[str, Column]:
    """What a model's answer decides: final, tool (with its name), or invalid, which calls for one repair."""
    made = json_in(answer)
    tool, final = F.get_json_object(made, "$.tool"), F.get_json_object(made, "$.final")
    valid = F.try_parse_json(made).isNotNull()
    kind = F.when(valid & final.isNotNull(), "final").when(valid & (tool != ""), "tool").otherwise("invalid")
    return {"kind": kind, "tool": F.when(kind == "tool", tool)}


def history_line(tool: Column, said: Column, most: int = 200) -> Column:
    return F.concat(tool, F.lit(": "), clipped(said, most))
