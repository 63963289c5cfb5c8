"""Template-driven extraction: templates as a table of rules, sections by start and end, required fields, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Window behind a label, confidences by where a value stands (with a value pattern, without), longest value.
WINDOW, LONGEST, WINDOW_LONGEST = 120, 500, 200
CONFIDENCE = {"same_line": (0.92, 0.88), "next_line": (0.9, 0.88), "window": (0.78, 0.65), "pattern_fallback": (0.45, 0.45)}
SEPARATOR = "[:：\\-–—|]"
MOST_TEMPLATES = 10_000
FOUND = "struct<field:string,section:string,required:boolean,value:string,method:string,confidence:double,label:string>"


def bind(value: str, name: str, body: str) -> str:
    """SQL of body with name standing for value, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def trimmed(c: str) -> str:
    return rf"nullif(regexp_replace({c}, r'^\s+|\s+$', ''), '')"


def rules_by_template(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """(template_id, window_size, rules, sections): one row a template.

    rules: template_id, field, labels, value_pattern, flags, section, required, window_size; sections: template_id, section, start,
    end, flags.  A pattern without flags ignores case.
    """
    flagged = lambda c: F.concat(F.lit("(?"), F.coalesce(F.nullif("flags", F.lit("")), F.lit("i")), F.lit(")"), c)
    rule = F.struct("field", "labels", flagged(F.col("value_pattern")).alias("pattern"), "section", F.coalesce("required", F.lit(False)).alias("required"))
    found = rules.groupBy("template_id").agg(F.max("window_size").alias("window_size"), F.sort_array(F.collect_list(rule)).alias("rules"))
    cuts = sections.groupBy("template_id").agg(F.sort_array(F.collect_list(F.struct("section", flagged(F.col("start")).alias("start"), flagged(F.col("end")).alias("end")))).alias("cuts"))
    return found.join(cuts, "template_id", "left")


#: (section, text) of each section: from behind its start to its end, or to the end of the text.
_END = "CASE WHEN regexp_instr(rest, c.end) > 0 THEN substring(rest, 1, regexp_instr(rest, c.end) - 1) ELSE rest END"
_BODY = bind("regexp_instr(text, c.start)", "at", f"CASE WHEN at > 0 THEN {bind('substring(text, at + length(regexp_extract(text, c.start, 0)))', 'rest', _END)} END")
_SECTIONS = f"transform(cuts, c -> named_struct('section', c.section, 'text', {trimmed(_BODY)}))"


def _value(candidate: str, pattern: str, longest: int, gap: str) -> str:
    """SQL of the value in a candidate: what the pattern finds, or all, up to a gap; null for none."""
    got = f"CASE WHEN {pattern} IS NULL THEN cand ELSE regexp_extract(cand, {pattern}, 0) END"
    cut = trimmed(rf"regexp_extract({got}, r'(?s)^(.*?)(?:{gap}|$)', 1)")
    return bind(candidate, "cand", bind(cut, "v", f"CASE WHEN length(v) <= {longest} THEN v END"))


def _found(value: str, method: str, label: str) -> str:
    """SQL of a struct for a value, null for none."""
    with_pattern, without = CONFIDENCE[method]
    confidence = f"CASE WHEN r.pattern IS NULL THEN {without}D ELSE {with_pattern}D END"
    return bind(value, "x", f"CASE WHEN x IS NOT NULL THEN named_struct('value', x, 'method', '{method}', 'confidence', {confidence}, 'label', {label}) END")


def _one_rule() -> str:
    """SQL of what rule r gives in scope sc (text, lines): the first line with a label that leads to a value decides.

    A line's label is its leftmost one.  The value stands behind it; or on the next line, if that doesn't begin with a label itself;
    or in the window behind the label.  Else the pattern may find it anywhere in the scope.
    """
    first_separator = lambda c: rf"regexp_replace({c}, r'(?s)^([^{SEPARATOR[1:]}*)(?:{SEPARATOR}\s*)?(.*)$', '$1 $2')"
    same = _found(_value(trimmed(first_separator("substring(line, m.at + length(m.l))")), "r.pattern", LONGEST, r"\s{2,}"), "same_line", "m.l")
    following = "regexp_replace(get(sc.lines, i + 1), r'^\\s+|\\s+$', '')"
    labelled = "exists(r.labels, l -> startswith(lower(nl), lower(l)))"
    after = bind(following, "nl", f"CASE WHEN NOT {labelled} THEN {_found(_value('nl', 'r.pattern', LONGEST, chr(92) + 's{2,}'), 'next_line', 'm.l')} END")
    behind = trimmed(f"replace({first_separator('substring(sc.text, instr(sc.text, line) - 1 + m.at + length(m.l), window_size)')}, chr(10), ' ')")
    near = _found(f"substring({_value(behind, 'r.pattern', 100_000, r'\s{2,}|,\s*(?=[A-Z])')}, 1, {WINDOW_LONGEST})", "window", "m.l")
    label_at = "array_min(filter(transform(r.labels, (l, j) -> named_struct('at', instr(lower(line), lower(l)), 'j', j, 'l', l)), z -> z.at > 0))"
    on_line = bind(label_at, "m", f"CASE WHEN m IS NOT NULL THEN coalesce({same}, {after}, {near}) END")
    on_lines = f"get(filter(transform(sc.lines, (line, i) -> {on_line}), h -> h IS NOT NULL), 0)"
    anywhere = _found("CASE WHEN size(r.labels) > 0 THEN nullif(trim(regexp_extract(sc.text, r.pattern, 0)), '') END", "pattern_fallback", "get(r.labels, 0)")
    return f"coalesce({on_lines}, {anywhere})"


_SCOPE = "coalesce(get(filter(scopes, s -> s.section = r.section AND s.text IS NOT NULL), 0), named_struct('section', CAST(NULL AS STRING), 'text', text, 'lines', lines))"
_ROW = bind(_one_rule(), "f", "named_struct('field', r.field, 'section', r.section, 'required', r.required, 'value', f.value, 'method', f.method, 'confidence', coalesce(f.confidence, 0D), 'label', f.label)")


def read(docs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(doc_id, template_id, text) and rules_by_template -> (doc_id, template_id, sections, found, known): documents of all templates in one job.

    found is an array of FOUND, one for each rule of the document's template; sections an array of (section, text).  A rule with a
    section looks there if the section is found, else in the whole text.  Lines are split once; the rules meet the documents by a
    broadcast where they are few.  Documents of unknown templates have null arrays and are not known; a null text counts as empty.
    Filter on known: a filter on found would be pushed down with a copy of all its expressions.
    """
    few = catalogue.limit(MOST_TEMPLATES + 1).count() <= MOST_TEMPLATES
    rows = docs.select("doc_id", "template_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(catalogue) if few else catalogue, "template_id", "left")
    rows = rows.withColumn("window_size", F.coalesce("window_size", F.lit(WINDOW))).withColumn("lines", F.split("text", "\n")).withColumn("sections", F.expr(_SECTIONS))
    rows = rows.withColumn("scopes", F.expr("transform(coalesce(sections, array()), s -> named_struct('section', s.section, 'text', s.text, 'lines', split(s.text, '\\n')))"))
    found = F.expr(f"transform(rules, r -> {bind(_SCOPE, 'sc', _ROW)})").cast(f"array<{FOUND}>")
    return rows.select("doc_id", "template_id", "sections", found.alias("found"), F.col("rules").isNotNull().alias("known"))


def sections(read_: DataFrame) -> DataFrame:
    """(doc_id, section, text) of read()."""
    return read_.select("doc_id", F.explode_outer("sections").alias("s")).where(F.col("s").isNotNull()).select("doc_id", "s.*")


def fields(read_: DataFrame) -> DataFrame:
    """(doc_id, template_id, FOUND) of read(): a row for each rule."""
    return read_.select("doc_id", "template_id", F.explode_outer("found").alias("f")).where(F.col("f").isNotNull()).select("doc_id", "template_id", "f.*")


def required(read_: DataFrame) -> DataFrame:
    """(doc_id, missing, valid): names of required fields without a value, in order; null where none is missing."""
    lack = F.sort_array(F.transform(F.filter("found", lambda f: f["required"] & f["value"].isNull()), lambda f: f["field"]))
    return read_.where("known").select("doc_id", F.when(F.size(lack) > 0, F.array_join(lack, ",")).alias("missing"), (F.size(lack) == 0).alias("valid"))


def assemble(read_: DataFrame) -> DataFrame:
    """(doc_id, values map<field, value>, by_section map<section, map<field, value>>) of read()."""
    entries = lambda fs: F.map_from_entries(F.transform(fs, lambda f: F.struct(f["field"], f["value"])))
    of = lambda s: F.filter("found", lambda f: f["section"] == s)
    names = F.array_distinct(F.filter(F.transform("found", lambda f: f["section"]), lambda s: s.isNotNull()))
    return read_.where("known").select("doc_id", entries(F.col("found")).alias("values"), F.map_from_entries(F.transform(names, lambda s: F.struct(s, entries(of(s))))).alias("by_section"))


def render(body: str, columns: list[str]) -> Column:
    """Mail merge: {{name}} from columns; null and unknown names give nothing."""
    out = F.lit(body)
    for c in columns:
        out = F.replace(out, F.lit("{{" + c + "}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.regexp_replace(out, r"\{\{[^}]*\}\}", "")
