"""Font profiles of printed books: from manifests and lists of files to style sheets and menu entries.

Profiles come as rows (profile, root, manifest, files): the folder's name, the rank of the root that it
lies in, its manifest as JSON text or null, and the names of its files.

Edge cases: a manifest that is no JSON object counts as empty; a profile with a name beyond ``[a-z0-9_]``,
without a regular font, or without a known family is left out; of equal names the later root wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Profiles that come first, in this order, and the ends of font files.
FIRST = ("noto_naskh_arabic", "amiri", "scheherazade_new", "kfgqpc_uthman_taha", "adwaa_lotfi", "ibm_plex_sans_arabic", "vazirmatn")
FONT_FILE = r"(?i)\.(otf|ttf)$"


def manifest_values(manifest: Column) -> Column:
    """The map of a manifest, without nulls; empty for anything but a JSON object."""
    is_object = F.schema_of_variant(F.try_parse_json(manifest)).like("OBJECT%")
    values = F.from_json(manifest, "map<string,string>")
    return F.map_filter(F.coalesce(F.when(is_object, values), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())


def font_file(values: Column, files: Column, key: str) -> Column:
    """The font file for ``key``: the manifest's if it lies in the folder, else one so named, else the first whose name has the key; for a regular font else any, one that isn't bold first."""
    fonts = F.array_sort(F.filter(files, lambda f: f.rlike(FONT_FILE)))
    told = F.try_element_at(values, F.lit(key))
    safe = ~told.rlike(r"^/|(^|/)\.\.(/|$)") & told.rlike(FONT_FILE) & F.array_contains(files, told)
    named = F.filter(F.array(F.lit(f"{key}.ttf"), F.lit(f"{key}.otf")), lambda f: F.array_contains(files, f))
    stem = lambda f: F.lower(F.regexp_replace(f, r"\.[^.]*$", ""))
    alike = F.filter(fonts, lambda f: stem(f).contains(key))
    found = [F.when(safe, told), F.get(named, F.lit(0)), F.get(alike, F.lit(0))]
    if key == "regular":
        found += [F.get(F.filter(fonts, lambda f: ~stem(f).contains("bold")), F.lit(0)), F.get(fonts, F.lit(0))]
    return F.coalesce(*found)


def profiles(folders: DataFrame, families: DataFrame) -> DataFrame:
    """id, label, family, regular, bold, bold_family, fallback and place (first those known, then by label) of usable folders; ``families`` (profile, root, file, family) is what the font files say."""
    good = folders.where(F.col("profile").rlike("^[a-z0-9_]+$")).withColumn("told", manifest_values(F.col("manifest")))
    files = F.coalesce("files", F.array().cast("array<string>"))
    rows = good.withColumns({"regular": font_file(F.col("told"), files, "regular"), "bold": font_file(F.col("told"), files, "bold")})
    by_file = families.groupBy("profile", "root").agg(F.map_from_entries(F.collect_set(F.struct("file", "family"))).alias("known"))
    rows = rows.where("regular IS NOT NULL").join(by_file, ["profile", "root"], "left")
    value = lambda key: F.try_element_at("told", F.lit(key))
    own = lambda file: F.try_element_at(F.coalesce("known", F.create_map().cast("map<string,string>")), file)
    label = F.array_join(F.transform(F.split("profile", "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")
    rows = rows.select(
        F.col("profile").alias("id"), "root", F.coalesce(value("label"), label).alias("label"), F.coalesce(F.nullif(value("family"), F.lit("")), own(F.col("regular"))).alias("family"), "regular", "bold",
        F.coalesce(F.nullif(value("bold_family"), F.lit("")), F.when(F.col("bold").isNotNull(), own(F.coalesce("bold", F.lit(""))))).alias("bold_family"), F.coalesce(value("fallback"), F.lit("serif")).alias("fallback"),
    )
    last = rows.where("family IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("label", "family", "regular", "bold", "bold_family", "fallback"), "root").alias("p")).select("id", "p.*")
    rank = F.array_position(F.array(*map(F.lit, FIRST)), F.col("id")).cast("int")
    return last.withColumn("place", F.struct(F.when(rank > 0, rank).otherwise(len(FIRST) + 1).alias("rank"), F.lower("label").alias("label")))


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy("place", "id")


def css_string(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def style_sheet(found: DataFrame) -> DataFrame:
    """id and css of profiles; headings and bold text have a rule of their own where their family differs."""
    family, bold = css_string(F.col("family")), css_string(F.col("bold_family"))
    # The elements that get a font.
    base = F.concat(F.lit('body, p, div, li, td, th, blockquote, span {\n  font-family: "'), family, F.lit('", '), F.col("fallback"), F.lit(" !important;\n}\n"))
    strong = F.concat(F.lit('\nb, strong, h1, h2, h3, h4, h5, h6 {\n  font-family: "'), bold, F.lit('", "'), family, F.lit('", '), F.col("fallback"), F.lit(" !important;\n}\n"))
    differs = F.col("bold").isNotNull() & F.coalesce(F.col("bold_family") != "", F.lit(False)) & (F.col("bold_family") != F.col("family"))
    return found.select("id", F.when(differs, F.concat(base, strong)).otherwise(base).alias("css"))


def menu(found: DataFrame) -> DataFrame:
    """value and label of the menu of profiles: the default first, then the profiles in order (by place); those known are translated under their own key."""
    shown = F.when(F.col("id").isin(*FIRST), F.concat("id", F.lit("_label"))).otherwise(F.col("label"))
    default = found.sparkSession.range(1).select(F.lit("default").alias("value"), F.lit("default_label").alias("label"), F.struct(F.lit(0).alias("rank"), F.lit("").alias("label")).alias("place"))
    return default.unionByName(found.select(F.col("id").alias("value"), shown.alias("label"), "place"))
