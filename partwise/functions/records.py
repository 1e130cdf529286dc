"""Manufacturing and medical features of a record held as map<field, text>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partwise.functions.text import WORD, bind, contains_any, first_contained, first_match, remove_all
from partwise.rules import manufacturing as MF
from partwise.rules import medical as MD


def record(fields: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])


def field(rec: Column, names: list[str]) -> Column:
    """First non-blank of the named fields, else null."""
    return F.coalesce(*[F.nullif(F.trim(rec[n]), F.lit("")) for n in names])


def all_text(rec: Column) -> Column:
    return F.array_join(F.map_values(rec), " ")


def name_keywords(name: Column, stop: list[str]) -> Column:
    words = F.regexp_extract_all(name, F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop))


# Manufacturing


def sizes(spec: Column, rec: Column) -> Column:
    """map<name, double>: the last match of each size pattern, plus the first number of each size field."""
    def last(pattern: str, group: int) -> Column:
        return F.try_element_at(F.regexp_extract_all(spec, F.lit("(?i)" + pattern), F.lit(group)), F.lit(-1))

    pairs = [(n, last(p, g).cast("double")) for n, p, g in MF.SIZES]
    factor = F.create_map(*[F.lit(x) for kv in MF.TO_MM.items() for x in kv])
    unit = F.lower(last(MF.SIZE_WITH_UNIT, 2))
    pairs.append(("size_mm", last(MF.SIZE_WITH_UNIT, 1).cast("double") * F.coalesce(factor[unit], F.lit(1.0))))
    number = {f: F.nullif(F.regexp_extract(rec[f], MF.NUM, 0), F.lit("")).cast("double") for f in MF.SIZE_FIELDS}
    # A size field replaces a pattern of the same name.
    merged = dict(pairs) | {f: F.coalesce(v, dict(pairs).get(f, F.lit(None).cast("double"))) for f, v in number.items()}
    built = F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), v)])
    return F.map_filter(built, lambda _, v: v.isNotNull())


def pressure_rating(spec: Column) -> Column:
    return first_match(spec, MF.PRESSURES)


def temperature_rating(rec: Column) -> Column:
    body = all_text(rec)
    span = F.when(body.rlike(MF.TEMPERATURE_RANGE), F.concat(
        F.regexp_extract(body, MF.TEMPERATURE_RANGE, 1), F.lit("~"), F.regexp_extract(body, MF.TEMPERATURE_RANGE, 2), F.lit("℃")))
    one = F.when(body.rlike(MF.TEMPERATURE_ONE), F.concat(F.regexp_extract(body, MF.TEMPERATURE_ONE, 1), F.lit("℃")))
    return F.coalesce(field(rec, MF.TEMPERATURE_FIELDS), span, one)


def standard(rec: Column, fields=MF.STANDARD_FIELDS, patterns=MF.STANDARDS) -> Column:
    return F.coalesce(field(rec, fields), first_match(all_text(rec), patterns))


def material_type(rec: Column) -> Column:
    named = F.upper(field(rec, MF.MATERIAL_FIELDS))
    by_field = first_contained(named, [([a.upper() for a in al], n) for n, al in MF.MATERIALS.items()])
    by_text = first_contained(all_text(rec), [(al, n) for n, al in MF.MATERIALS.items()])
    return F.coalesce(by_field, named, by_text, F.lit(MF.UNKNOWN_MATERIAL))


def technical_parameters(rec: Column) -> Column:
    named = F.map_filter(F.create_map(*[x for f in MF.TECH_FIELDS for x in (F.lit(f), rec[f])]), lambda _, v: F.coalesce(v, F.lit("")) != "")
    spec = rec["规格型号"]
    parsed = {k: F.when(spec.rlike(p), F.concat_ws(" ", F.regexp_extract(spec, p, 1), F.regexp_extract(spec, p, 2)))
              for k, p in MF.TECH_PATTERNS.items()}
    found = F.map_filter(F.create_map(*[x for k, v in parsed.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(named, lambda k, _: ~F.map_contains_key(found, k)), found)


def size_signature(size: Column) -> Column:
    parts = [F.when(size[p].isNotNull(), F.concat(F.lit(f"{p}:"), size[p].cast("string"))) for p in MF.SIGNATURE_ORDER]
    return F.concat_ws("|", *parts)


def pressure_class(rating: Column) -> Column:
    up = F.upper(rating)
    return F.coalesce(first_contained(up, [([c], p) for c, p in MF.CLASS_TO_PN.items()]), up)


def material_properties(kind: Column) -> Column:
    table = F.create_map(*[
        x for k, props in MF.MATERIAL_PROPERTIES.items()
        for x in (F.lit(k), F.create_map(*[F.lit(v) for kv in props.items() for v in kv]))])
    return table[kind]


def plain_maker(maker: Column, suffixes: list[str] = MF.MAKER_SUFFIXES) -> Column:
    return F.trim(remove_all(maker, suffixes))


def category_levels(text: Column, categories, level3) -> Column:
    """struct(level1, level2, level3) of the first category with a keyword in the text, case ignored."""
    def pick(low: Column) -> Column:
        none = F.lit(None).cast("string")
        out = F.when(F.lit(False), F.struct(none.alias("level1"), none.alias("level2"), none.alias("level3")))
        for family, one, two, words in categories:
            third = first_contained(low, level3[family]) if family in level3 else none
            hit = F.struct(F.lit(one).alias("level1"), F.lit(two).alias("level2"), third.alias("level3"))
            out = out.when(contains_any(low, [w.lower() for w in words]), hit)
        unknown = F.lit(MF.UNCLASSIFIED)
        return out.otherwise(F.struct(unknown.alias("level1"), unknown.alias("level2"), none.alias("level3")))

    return bind(F.lower(text), pick)


# Medical


def registration_no(rec: Column) -> Column:
    return F.coalesce(field(rec, MD.REGISTRATION_FIELDS), first_match(all_text(rec), MD.REGISTRATIONS, ""))


def expiry_date(rec: Column) -> Column:
    return F.coalesce(field(rec, MD.EXPIRY_FIELDS), first_match(all_text(rec), MD.DATES, ""))


def dosage_form(rec: Column, name: Column) -> Column:
    text = F.concat_ws(" ", name, F.coalesce(rec["规格"], F.lit("")))
    forms = [([f], f) for forms in MD.DOSAGE_FORMS.values() for f in forms]
    return F.coalesce(field(rec, MD.FORM_FIELDS), first_contained(text, forms))


def _field_matching(rec: Column, names: list[str], pattern: str) -> Column:
    return F.coalesce(*[F.when(rec[n].rlike(pattern), F.trim(rec[n])) for n in names])


def concentration(rec: Column) -> Column:
    return F.coalesce(_field_matching(rec, MD.CONCENTRATION_FIELDS, "(?i)" + MD.HAS_CONCENTRATION), first_match(all_text(rec), MD.CONCENTRATIONS))


def package_spec(rec: Column) -> Column:
    return F.coalesce(_field_matching(rec, MD.PACKAGE_FIELDS, MD.HAS_PACKAGE), first_match(all_text(rec), MD.PACKAGES, ""))


def medical_standard(rec: Column) -> Column:
    return standard(rec, MD.STANDARD_FIELDS, MD.STANDARDS)


def device_type(rec: Column) -> Column:
    return F.coalesce(field(rec, MD.TYPE_FIELDS), first_contained(F.coalesce(rec["产品名称"], F.lit("")), MD.TYPE_WORDS, MD.UNKNOWN_TYPE))


def regulatory_class(rec: Column, name: Column) -> Column:
    named = field(rec, MD.CLASS_FIELDS)
    return F.coalesce(first_contained(named, [(w, label) for w, label, _ in MD.CLASSES]), named,
                      first_contained(name, MD.CLASS_BY_NAME), F.lit(MD.UNCLASSIFIED))


def class_level(label: Column) -> Column:
    return first_contained(label, [(w, level) for w, _, level in MD.CLASSES], 0)


def clinical_parameters(rec: Column) -> Column:
    pairs = {f: rec[f] for f in MD.CLINICAL_FIELDS}
    pairs |= {f: field(rec, names) for f, names in MD.CLINICAL_ALIASES.items()}
    built = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    return F.map_filter(built, lambda _, v: F.coalesce(v, F.lit("")) != "")


def dosage_group(form: Column) -> Column:
    table = F.create_map(*[F.lit(x) for group, forms in MD.DOSAGE_FORMS.items() for f in forms for x in (f, group)])
    return table[form]


def concentration_parts(value: Column) -> Column:
    """struct(value, unit, mg); null when the text holds no number and unit."""
    number = F.regexp_extract(value, MD.CONCENTRATION_PARTS, 1).try_cast("double")
    unit = F.regexp_extract(value, MD.CONCENTRATION_PARTS, 2)
    factor = F.create_map(*[F.lit(x) for kv in MD.TO_MG.items() for x in kv])
    return F.when(number.isNotNull(), F.struct(
        number.alias("value"), unit.alias("unit"), (number * F.coalesce(factor[F.lower(unit)], F.lit(1.0))).alias("mg")))


def therapeutic_area(indication: Column) -> Column:
    return first_contained(F.lower(indication), [(words, area) for area, words in MD.THERAPEUTIC_AREAS])

