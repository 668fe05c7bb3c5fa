"""Decision tables: which outputs an input has, which backend converts, with which options and steps.

A route is a row with ``input`` and ``output`` and, where options matter, a
column for each option; every rule is a boolean column, so routes are planned
as rows of any number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans import domains as D


def _in(column: str, values: list[str]) -> Column:
    return F.col(column).isin(values)


def _lookup(column: str, names: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return F.try_element_at(pairs, F.col(column))


def extension(name: Column) -> Column:
    """Lower-case text after the last dot (all of it without a dot); null for an empty name."""
    return F.element_at(F.split(F.lower(F.nullif(name, F.lit(""))), r"\."), -1)


def is_supported(name: Column) -> Column:
    return F.coalesce(extension(name).isin(D.INPUTS), F.lit(False))


def same_format() -> Column:
    """Both ends are one type or have one name in pandoc; two types unknown to it count as one."""
    return (F.col("input") == F.col("output")) | _lookup("input", D.READERS).eqNullSafe(_lookup("output", D.WRITERS))


def routes(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """All allowed (input, output), with the position of the output in its list; both sides are small dimension tables."""
    pairs = inputs.select("input").crossJoin(F.broadcast(outputs.select("output", F.col("pos").alias("output_pos"))))  # 31 rows
    calibre, pandoc = _in("output", D.CALIBRE_OUTPUTS), _in("output", list(D.WRITERS))
    allowed = (
        F.when(F.col("input") == "doc", F.lit(True))
        .when(~_in("input", list(D.READERS)), calibre)
        .when(_in("input", D.PANDOC_ONLY_INPUTS), pandoc & ~same_format())
        .otherwise(((F.col("input") == "epub") & (F.col("output") == "epub")) | ~same_format())
    )
    return pairs.where(allowed)


def with_defaults(requests: DataFrame) -> DataFrame:
    """Every option as a column; options that ``requests`` lacks or leaves null take their defaults."""
    have = set(requests.columns)
    out = {}
    for name, default in D.OPTION_DEFAULTS.items():
        kind = "boolean" if isinstance(default, bool) else "int" if name in ("line_height", "kfx_pages", "pandoc_heading_shift") else "string"
        out[name] = F.coalesce(F.col(name), F.lit(default)).cast(kind) if name in have else F.lit(default).cast(kind)
    return requests.withColumns(out)


def calibre_converts() -> Column:
    return ~_in("input", D.PANDOC_ONLY_INPUTS) & _in("output", D.CALIBRE_OUTPUTS)


# Fixed values below: options that pandoc does not have.
def beyond_pandoc() -> Column:
    """Some option is set that pandoc can't honour on this route."""
    c, epub = F.col, F.col("input") == "epub"
    terms = [
        c("force_rtl") & ~_in("output", D.RTL_OUTPUTS), c("pandoc_toc") & ~_in("output", D.TOC_OUTPUTS), c("pandoc_number_sections") & ~_in("output", D.NUMBERED_OUTPUTS),
        c("pdf_no_cover") & (c("output") == "pdf"), c("line_height").isNotNull(), c("kfx_pages").isNotNull(),
        *[c(name) & ~epub for name in ("fix_epub", "flat_toc", "epub_standardize_footnotes")],
        *[c(name) & (c("output") != "docx") for name in ("docx_header_pagebreaks", "docx_arabic_reference")],
        *[c(name) for name in ("compress_cover", "smarten_punctuation", "remove_paragraph_spacing", "docx_no_toc", "epub_inline_toc", "epub_remove_background", "epub_split_volumes", "pdf_page_numbers", "pdf_no_chapter_pagebreak")],
        *[c(name) != D.OPTION_DEFAULTS[name] for name in ("change_justification", "kfx_doc_type", "docx_page_size", "epub_version", "pdf_paper_size", "pdf_font_profile")],
    ]
    return F.coalesce(F.exists(F.array(*terms), lambda t: t), F.lit(False))


def pandoc_converts() -> Column:
    return _in("input", list(D.READERS)) & _in("output", list(D.WRITERS)) & ~same_format() & ~beyond_pandoc()


def backend() -> Column:
    """The preferred backend if it can, else Calibre, else pandoc; Calibre where neither can."""
    return F.when((F.col("conversion_backend") == "pandoc") & pandoc_converts(), "pandoc").when(calibre_converts(), "calibre").when(pandoc_converts(), "pandoc").otherwise("calibre")


def menu_uses_pandoc() -> Column:
    shared = (F.col("conversion_backend") == "pandoc") & _in("input", D.MENU_SHARED_INPUTS) & _in("output", D.MENU_SHARED_OUTPUTS)
    return _in("output", D.PANDOC_ONLY_OUTPUTS) | _in("input", D.PANDOC_ONLY_INPUTS) | shared


def effective_options() -> dict[str, Column]:
    """The value each option has on a route; one that the route doesn't offer has its neutral value."""
    c, output, pandoc, epub = F.col, F.col("output"), menu_uses_pandoc(), F.col("input") == "epub"
    calibre = ~pandoc
    common = calibre & _in("output", D.COMMON_OUTPUTS)
    offered: dict[str, Column] = {
        "force_rtl": F.when(pandoc, _in("output", D.RTL_OUTPUTS)).otherwise(_in("output", ["epub", "pdf"])),
        "compress_cover": calibre & _in("output", D.POLISH_OUTPUTS),
        "fix_epub": epub, "flat_toc": epub, "epub_standardize_footnotes": epub,
        "smarten_punctuation": common, "change_justification": common, "line_height": common, "remove_paragraph_spacing": common,
        "pandoc_toc": pandoc & _in("output", D.TOC_OUTPUTS), "pandoc_number_sections": pandoc & _in("output", D.NUMBERED_OUTPUTS), "pandoc_heading_shift": pandoc,
        "docx_header_pagebreaks": pandoc & (output == "docx"), "docx_arabic_reference": pandoc & (output == "docx"),
        "epub_split_volumes": calibre & (output == "epub") & epub,
    }
    for kind, names in {"docx": ("docx_page_size", "docx_no_toc"), "epub": ("epub_version", "epub_inline_toc", "epub_remove_background"), "pdf": ("pdf_paper_size", "pdf_font_profile", "pdf_page_numbers", "pdf_no_cover", "pdf_no_chapter_pagebreak"), "kfx": ("kfx_doc_type", "kfx_pages")}.items():
        offered |= {name: calibre & (output == kind) for name in names}
    neutral = D.OPTION_DEFAULTS | {"pdf_no_cover": False}
    values = {name: F.when(offered[name], c(name)).otherwise(F.lit(neutral[name])) for name in D.OPTION_DEFAULTS if name in offered}
    return values | {"conversion_backend": F.when(pandoc, "pandoc").otherwise("calibre")}


def rebuilds_epub() -> Column:
    c = F.col
    changed = c("smarten_punctuation") | c("remove_paragraph_spacing") | (c("change_justification") != "original") | (c("epub_version") != "default") | c("epub_inline_toc") | c("epub_remove_background")
    return (c("input") == "epub") & (c("output") == "epub") & changed


def plan() -> Column:
    """The name of the chain of steps for a route; ``none`` where the file stays as it is or nothing can convert it."""
    c, source, target = F.col, F.col("input"), F.col("output")
    converts = F.when(backend() == "pandoc", pandoc_converts()).otherwise(calibre_converts())
    return (
        F.when((source == "epub") & (target == "epub") & c("epub_split_volumes"), "split volumes")
        .when(source == "bok", F.when(target == "epub", "assemble").when(target == "kfx", "assemble, to kfx").otherwise("assemble, convert"))
        .when(source == "doc", F.when(target == "txt", "extract text").when(target == "kfx", "none").otherwise("extract text, convert"))
        .when(source == "pdf", F.when(target == "pdf", "none").when(target == "kfx", "extract pages, epub, to kfx").otherwise("extract pages, convert"))
        .when((target == "pdf") & c("force_rtl") & (source != "epub"), "epub, right to left, pdf")
        .when(_in("input", D.KFX_INPUTS), "from kfx")
        .when((target == "kfx") & ~_in("input", D.KFX_SOURCES), "none")
        .when(target == "kfx", "to kfx")
        .when((source == target) & ~rebuilds_epub(), "none")
        .when(rebuilds_epub() & converts, "rebuild epub")
        .when(converts, backend())
        .otherwise("none")
    )


def option_events(log: DataFrame) -> DataFrame:
    """Valid changes of a log (request, seq, input, key, value): ``option`` and ``new`` (JSON text), ``reset`` rows included.

    Menu keys name options; 1 and 0 set switches, which on some options works for EPUB input only.
    """
    key = F.coalesce(_lookup("key", D.MENU_KEYS), F.col("key"))
    switch = F.when(F.col("value") == "1", "true").when(F.col("value") == "0", "false")
    words = {f"{o}={v}": D.MENU_WORDS.get((o, str(v)), v) for o, vs in D.OPTION_VALUES.items() if o != "options_context" for v in vs if v is not None}
    words = {k: v for k, v in words.items() if k not in ("kfx_pages=0", "pandoc_heading_shift=0", "pandoc_heading_shift=-1", "pandoc_heading_shift=1")}
    words |= {f"{o}={w}": v for (o, w), v in D.MENU_WORDS.items()}
    texts = {k: "null" if v is None else str(v) if isinstance(v, int) else f'"{v}"' for k, v in words.items()}
    chosen = F.try_element_at(F.create_map(*[F.lit(x) for item in texts.items() for x in item]), F.concat_ws("=", key, "value"))
    allowed = ~key.isin(D.EPUB_ONLY_OPTIONS) | (F.col("input") == "epub")
    new = F.when(F.col("key") == "reset", F.lit("")).when(key.isin(D.BOOLEAN_OPTIONS), F.when(allowed, switch)).otherwise(chosen)
    return log.select("request", "seq", F.when(F.col("key") == "reset", "reset").otherwise(key).alias("option"), new.alias("new")).where("new IS NOT NULL")


def options_after(events: DataFrame) -> DataFrame:
    """The last value of each option of each request, of the changes after its last reset."""
    resets = events.where("option = 'reset'").groupBy("request").agg(F.max("seq").alias("_reset"))
    later = events.where("option <> 'reset'").join(resets, "request", "left").where("_reset IS NULL OR seq > _reset")
    return later.groupBy("request", "option").agg(F.max_by("new", "seq").alias("value"))


def persisted_options(text: Column, source: Column) -> dict[str, Column]:
    """Each option as saved in a JSON text, where it is a value that the option may have; else its default.

    Types are strict: a switch needs a JSON boolean, a number a JSON integer.
    """
    parsed = F.try_parse_json(text)
    top = F.when(F.schema_of_variant(parsed).like("OBJECT%"), parsed)
    out: dict[str, Column] = {}
    for name, default in D.OPTION_DEFAULTS.items():
        path = f"$.{name}"
        kind = F.schema_of_variant(F.try_variant_get(top, path, "variant"))
        if isinstance(default, bool):
            value = F.when(kind == "BOOLEAN", F.try_variant_get(top, path, "boolean"))
            value = F.when(source == "epub", value) if name in D.EPUB_ONLY_OPTIONS else value
        elif name in ("line_height", "kfx_pages", "pandoc_heading_shift"):
            value = F.when(kind == "BIGINT", F.try_variant_get(top, path, "int"))
            value = F.when(value.isin([v for v in D.OPTION_VALUES[name] if v is not None]), value)
        else:
            value = F.when(kind == "STRING", F.try_variant_get(top, path, "string"))
            value = F.when(value.isin(D.OPTION_VALUES[name]), value)
        out[name] = F.coalesce(value, F.lit(default))
    return out


def options_json() -> Column:
    """All options of a row as compact JSON text, nulls kept."""
    return F.to_json(F.struct(*map(F.col, D.OPTION_DEFAULTS)), {"ignoreNullFields": "false"})
