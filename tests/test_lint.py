"""Lint rules on labels written as dicts, and label tables."""

import pytest

from lading.operators import classify as c
from lading.operators import lint
from lading.spec import Specs

BASE = {
    "dataset": "d", "delivery_id": 1, "time": {"delivery_start_date": "2026-01-02"},
    "delivery_meta": {"schema_version": "0.1.0"},
}


def _label(ft=None, **more):
    return BASE | {"filetypes": {"t": ft or {"filename": r"\.txt$"}}} | more


def _fits(**obj):
    first = {"name": "p", "objtype": "primary"}
    return _label({"filename": "x", "standard": "fits", "objects": [first, {"name": "n", "objtype": "image"} | obj]})


def _asdf(**obj):
    return _label({"filename": "x", "standard": "asdf", "objects": [{"name": "n", "objtype": "ndarray"} | obj]})


COLUMN = {"name": "a", "dtype": "i4"}
CASES = [
    (_label(), []),
    ({k: v for k, v in BASE.items() if k != "time"}, ["/time"]),
    (_label(colour="red"), ["/colour"]),
    (BASE | {"time": {"delivery_start_date": "soon"}}, ["/time/delivery_start_date"]),
    (_label(contacts={"provider": ["a@b.c", "nobody"]}), ["/contacts/provider/1"]),
    (_label({"filename": []}), ["/filetypes/t/filename"]),
    (_label({"filename": ["(?!)x"]}), ["/filetypes/t/filename"]),
    (_label({"filename": "x", "ignore": True, "standard": "pdf", "validation_options": {"skip": ["all"]}}),
     ["/filetypes/t/standard", "/filetypes/t/validation_options"]),
    (_label({"filename": "x", "standard": "pdf", "objects": [{"name": "n"}]}), ["/filetypes/t/standard"]),
    (_label({"filename": "x", "objects": [{"name": "n"}]}), ["/filetypes/t/standard"]),
    (_label({"filename": "x", "standard": "parquet", "objects": [{}, {}]}), ["/filetypes/t/objects"]),
    (_label({"filename": "x", "standard": "fits", "objects": [{"objtype": "image"}]}), ["/filetypes/t/objects/0/objtype"]),
    (_label({"filename": "x", "standard": "parquet", "objects": [{"schema": [{"name": "a", "dtype": "c8"}, {"name": "b"}]}]}),
     ["/filetypes/t/objects/0/schema/0/dtype", "/filetypes/t/objects/0/schema/1/dtype", "/filetypes/t/objects/0/schema/1/dtype"]),
    (_fits(dtype="f2"), ["/filetypes/t/objects/1/dtype"]),
    (_fits(objtype="table"), ["/filetypes/t/objects/1/objtype"]),
    (_fits(value=3), ["/filetypes/t/objects/1/value"]),
    (_fits(name=["a", "b"]), ["/filetypes/t/objects/1/name"]),
    (_fits(objtype="bintable", ndim=1), ["/filetypes/t/objects/1/ndim"]),
    (_fits(schema=[COLUMN]), ["/filetypes/t/objects/1/schema"]),
    (_fits(metadata={"K": {"index": 0}, "k": {}}), ["/filetypes/t/objects/1/metadata/K"]),
    (_asdf(), []),
    (_asdf(name=None), ["/filetypes/t/objects/0/name"]),
    (_asdf(objtype="str", ndim=1), ["/filetypes/t/objects/0/ndim"]),
    (_asdf(objtype="a-b.c"), ["/filetypes/t/objects/0/objtype"]),
    (_asdf(value=1, schema=[COLUMN]), ["/filetypes/t/objects/0/value"]),
    (_asdf(dtype="i4", schema=[COLUMN]), ["/filetypes/t/objects/0/schema"]),
    (_asdf(metadata={"K": {"value": 1}}), ["/filetypes/t/objects/0/metadata/K"]),
]


@pytest.fixture(scope="module")
def found(spark):
    """All labels linted in one job, as an archive."""
    labels = [label | {"delivery_id": i} for i, (label, _) in enumerate(CASES)]
    problems = lint.lint_specs(Specs.from_labels(spark, labels))
    by_label = {}
    for row in problems.collect():
        by_label.setdefault(int(row.delivery_id), []).append(row.lpath)
    return by_label


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rules(found, i):
    assert sorted(found.get(i, [])) == sorted(CASES[i][1])


def test_extra_rules_and_rollup(spark):
    def short_names(specs):
        return specs.types.filter("length(type) < 2").selectExpr(
            "dataset", "delivery_id", "'/filetypes/' || type AS lpath", "'name too short' AS problem"
        )

    specs = Specs.from_labels(spark, [_label({"filename": []})])
    rolled = lint.sorted_spec_report(lint.lint_specs(specs, [short_names])).collect()
    assert [(r.lpath, r.n_problems) for r in rolled] == [("/filetypes/t", 1), ("/filetypes/t/filename", 1)]


def test_classification_details(spark):
    label = _label() | {
        "filetypes": {
            "text": {"filename": [r"\.txt$", r"(?!)secret"]},
            "junk": {"filename": "tmp", "ignore": True},
            "data": {"filename": r"\.parquet$", "standard": "parquet", "validation_options": {"skip": ["all"]}},
        }
    }
    specs = Specs.from_labels(spark, [label])
    names = ["a.txt", "secret.txt", "tmp.txt", "CONTENTS.YML", "x/CONTENTS.YML", "d.parquet", "tmp/x"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    classified = c.classify(files, specs)
    report = {r.path: (r.filetypes, r.status) for r in c.filetype_report(classified).collect()}
    assert report["a.txt"] == ("text", "assigned") and report["tmp.txt"] == ("junk;text", "ambiguous")
    assert report["secret.txt"] == ("", "unassigned")
    kept = {r.path for r in c.exempt_label_file(classified).collect()}
    assert "CONTENTS.YML" not in kept and "x/CONTENTS.YML" in kept
    assert "tmp/x" not in {r.path for r in c.drop_ignored(classified, specs).collect()}
    needs = {r.type: r.needs_data for r in c.needs_data_check(specs).collect()}
    assert needs == {"text": False, "junk": False, "data": False}


def test_forms_and_kinds_of_values(spark):
    label = {
        "dataset": ["d"], "delivery_id": 1, "contacts": "nobody", "time": {"delivery_start_date": "soon"},
        "delivery_meta": {"schema_version": "1", "global_validation_options": {"skip": "all", "missing_filetypes_ok": "perhaps"}},
        "filetypes": {"t": {"filename": "x", "standard": {"a": 1}, "validation_options": {"skip": {"b": 2}}, "objects": [
            {"name": ["a", "b"], "ndim": "99999999999999999999999999", "value": "a(", "value_regex": True, "schema": "none"},
            {"name": {"c": 1}, "ndim": 1.5, "value": "a(", "metadata": {"m": {"value": "(", "value_regex": "true"}}}]}},
    }
    label["filetypes"]["t"]["standard"] = "parquet"
    found = {}
    for r in lint.scalar_errors(_specs_of_props(spark, label)).collect():
        found[r.lpath] = r.problem
    assert found == {
        "/dataset": "bad value; expected a scalar, got a list",
        "/contacts": "bad value; expected a mapping, got a scalar",
        "/time/delivery_start_date": "bad value; 'soon' could not be parsed as a date",
        "/delivery_meta/global_validation_options/missing_filetypes_ok": "bad value; 'perhaps' could not be parsed as a boolean value",
        "/filetypes/t/validation_options/skip": "bad value; expected a list, got a map",
        "/filetypes/t/objects/0/value": "bad value; 'a(' could not be parsed as a regex",
        "/filetypes/t/objects/0/schema": "bad value; expected a list of mappings, got a scalar",
        "/filetypes/t/objects/1/name": "bad value; expected a name or a list of names, got a map",
        "/filetypes/t/objects/1/ndim": "bad value; '1.5' could not be parsed as an integer",
        "/filetypes/t/objects/1/metadata/m/value": "bad value; '(' could not be parsed as a regex",
    }


def _specs_of_props(spark, label):
    """Only the table of properties: such a label can't be loaded as a whole."""
    from dataclasses import replace

    from lading import schemas
    from lading.spec import _property_rows, local_table

    rows = [("d", "1", *row) for row in _property_rows(label)]
    return replace(Specs.from_labels(spark, []), props=local_table(spark, rows, schemas.SPEC_PROPS))
