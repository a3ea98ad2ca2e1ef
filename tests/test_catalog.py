"""FITS-like and ASDF-like catalogues, given as decoded tables."""

from pyspark.sql import functions as F

from lading import schemas
from lading.plans import validate as v
from lading.plans.describe import describe_hdus, describe_trees
from lading.sources.catalog import Catalog, empty_catalog, load_object_catalog
from lading.spec import Specs


def _hdu(path, ix, name, objtype, dtype=None, ndim=None):
    return (path, ix, name, objtype, dtype, ndim, dtype is not None or objtype == "bintable")


OBJECTS = [
    row
    for path, n in (("f1", 2), ("f2", 3))
    for row in [
        _hdu(path, 0, "PRIMARY", "primary"),
        *[_hdu(path, 1 + i, f"SCI_{i}", "image", "i4", 2) for i in range(n)],
        _hdu(path, 1 + n, "CAT", "bintable"),
    ]
]
COLUMNS = [
    (path, ix, i, name, code, 0)
    for path, ix in (("f1", 3), ("f2", 4))
    for i, (name, code) in enumerate([("id", "i4"), ("mag", "f4")])
]
META = [
    (path, 0, pos, key, value, kind)
    for path in ("f1", "f2")
    for pos, (key, value, kind) in enumerate(
        [("TELESCOP", "X", "str"), ("HISTORY", "a", "str"), ("HISTORY", "b", "str"), ("GAIN", "1.5", "float")]
    )
]


def _catalog(spark, **rows):
    frames = {n: getattr(empty_catalog(spark), n) for n in ("objects", "columns", "meta", "nodes")}
    layouts = {"objects": schemas.OBJECTS, "columns": schemas.COLUMNS, "meta": schemas.META_KV, "nodes": schemas.NODES}
    frames |= {n: spark.createDataFrame(r, layouts[n]) for n, r in rows.items()}
    return Catalog(**frames)


def _files(spark, paths, type_, skips=()):
    return spark.createDataFrame(
        [(p, type_, list(skips)) for p in paths], "path string, type string, skips array<string>"
    )


def _label(objects, standard="fits", **more):
    ft = {"filename": ".*", "standard": standard, "objects": objects, **more}
    return {"dataset": "d", "delivery_id": 1, "filetypes": {"t": ft}}


def _found(failures):
    return sorted((r.path, r.object, r.check, r.key, r.message) for r in failures.collect())


GOOD = [
    {"name": "primary", "objtype": "primary", "ndim": 0, "metadata": {
        "TELESCOP": {"value": "X"}, "GAIN": {"value": 1.5}, "history": {"index": 1, "value": "b"}}},
    {"name": r"SCI_\d", "objtype": "image", "dtype": "i4", "ndim": 2, "repeated": True},
    {"name": "cat", "objtype": "bintable", "schema": [{"name": "id", "dtype": "i4"}, {"name": "mag", "dtype": "f4"}]},
]


def test_conforming_hdus(spark):
    catalog = _catalog(spark, objects=OBJECTS, columns=COLUMNS, meta=META)
    specs = Specs.from_labels(spark, [_label(GOOD)])
    assert _found(v.validate_hdus(_files(spark, ["f1", "f2"], "t"), catalog, specs)) == []


def test_hdu_failures(spark):
    catalog = _catalog(spark, objects=OBJECTS, columns=COLUMNS, meta=META)
    objects = [
        {"objtype": "image", "metadata": {"HISTORY": {}, "GAIN": {"value": 1}, "NONE": {}}},
        {"name": r"SCI_\d", "objtype": "image", "dtype": "f8", "ndim": 2, "repeated": True},
        {"name": "cat", "objtype": "bintable", "schema": [{"name": "id", "dtype": "i8"}]},
        {"name": "more", "objtype": "image"},
        {"name": "maybe", "objtype": "image", "optional": True},
    ]
    specs = Specs.from_labels(spark, [_label(objects)])
    found = _found(v.validate_hdus(_files(spark, ["f1"], "t"), catalog, specs))
    assert [f[1:4] for f in found] == [
        ("0", "metadata", "GAIN"), ("0", "metadata", "HISTORY"), ("0", "metadata", "NONE"),
        ("0", "objtype", ""), ("1", "array_props", ""), ("2", "array_props", ""),
        ("3", "schema", "0"), ("3", "schema", "1"), ("4", "base", ""),
    ]
    skipped = v.validate_hdus(_files(spark, ["f1"], "t", ["schema", "metadata", "dtype"]), catalog, specs)
    assert [f[1:3] for f in _found(skipped)] == [("0", "objtype"), ("4", "base")]
    short = Specs.from_labels(spark, [_label(GOOD[:1])])
    extra = [f for f in _found(v.validate_hdus(_files(spark, ["f2"], "t"), catalog, short)) if f[4] == "extra"]
    assert [f[1] for f in extra] == ["1", "2", "3", "4"]


def test_describe_hdus(spark):
    catalog = _catalog(spark, objects=OBJECTS, columns=COLUMNS)
    typed = _files(spark, ["f1", "f2"], "t").select("path", "type")
    got = describe_hdus(catalog.objects.join(typed, "path"), catalog.columns.join(typed, "path"))
    assert got.problems.collect() == []
    objects = [(r.obj_ix, r.name, r.repeated, r.dtype) for r in got.objects.orderBy("obj_ix").collect()]
    assert objects == [
        (0, "PRIMARY", False, None), (1, r"SCI((?:_|\d)*\d+)", True, "i4"), (2, "CAT", False, None),
    ]
    columns = [(r.obj_ix, r.col_ix, r.name, r.dtype) for r in got.columns.orderBy("col_ix").collect()]
    assert columns == [(2, 0, "id", "i4"), (2, 1, "mag", "f4")]


def _node(path, ix, node, objtype, dtype=None, ndim=None, value=None, kind=None):
    return (path, ix, list(node), objtype, dtype, ndim, value, kind)


NODES = [
    row
    for path, n in (("a1", 1), ("a2", 3))
    for row in [
        _node(path, 0, ("roman",), "builtins.dict"),
        _node(path, 1, ("roman", "products", "image"), "numpy.ndarray", "f4", 2),
        _node(path, 2, ("version",), "builtins.str", value="1.0", kind="str"),
        _node(path, 3, ("z",), "builtins.complex", value="(1+2j)", kind="complex"),
        *[_node(path, 10 + i, ("roman", "products", f"catalog_{i:04d}"), "astropy.table.table.Table") for i in range(n)],
    ]
]
TREE_COLUMNS = [
    (path, 10 + k, i, name, code, 0)
    for path, n in (("a1", 1), ("a2", 3))
    for k in range(n)
    for i, (name, code) in enumerate([("source_id", "i4"), ("good", "b1")])
]
TREE = [
    {"name": ["roman", "products", "image"], "objtype": "ndarray", "dtype": "f4", "ndim": 2},
    {"name": "version", "objtype": "str", "value": r"1\.\d", "value_regex": True},
    {"name": "z", "objtype": "complex", "value": "(1+2j)"},
    {"name": ["roman", "products", r"catalog_\d+"], "repeated": True, "objtype": "astropy.table.table.Table",
     "schema": [{"name": "source_id", "dtype": "i4"}, {"name": "good", "dtype": "b1"}]},
]


def test_conforming_trees(spark):
    catalog = _catalog(spark, nodes=NODES, columns=TREE_COLUMNS)
    specs = Specs.from_labels(spark, [_label(TREE, "asdf")])
    assert _found(v.validate_nodes(_files(spark, ["a1", "a2"], "t"), catalog, specs)) == []


def test_tree_failures(spark):
    catalog = _catalog(spark, nodes=NODES, columns=TREE_COLUMNS)
    objects = [
        {"name": ["roman", "products", "image"], "objtype": "table", "dtype": "f8", "ndim": 3},
        {"name": "version", "objtype": "str", "value": "2"},
        {"name": ["roman", "products", "catalog"], "name_regex": True, "objtype": "table",
         "schema": [{"name": "source_id", "dtype": "i8"}, {"name": "good", "dtype": "b1"}]},
        {"name": "absent", "objtype": "int"},
        {"name": "maybe", "objtype": "int", "optional": True},
    ]
    specs = Specs.from_labels(spark, [_label(objects, "asdf")])
    found = _found(v.validate_nodes(_files(spark, ["a2"], "t"), catalog, specs))
    image = "root/roman/products/image"
    assert [f[1:4] for f in found] == [
        ("10", "schema", "0"), ("11", "schema", "0"), ("12", "schema", "0"),
        ("absent", "base", ""), ("roman/products/catalog", "base", ""),
        (image, "array_props", ""), (image, "array_props", ""), (image, "objtype", ""),
        ("root/version", "value", ""),
    ]


def test_describe_trees(spark):
    catalog = _catalog(spark, nodes=NODES, columns=TREE_COLUMNS)
    typed = _files(spark, ["a1", "a2"], "t").select("path", "type")
    got = describe_trees(catalog.nodes.join(typed, "path"), catalog.columns.join(typed, "path"))
    assert got.problems.collect() == []
    names = {tuple(r.name_path): (r.repeated, r.dtype) for r in got.objects.collect()}
    assert names == {
        ("roman",): (False, None), ("version",): (False, None), ("z",): (False, None),
        ("roman", "products", "image"): (False, "f4"),
        ("roman", "products", r"catalog((?:_|\d)*\d+)"): (True, None),
    }
    assert [r.name for r in got.columns.orderBy("col_ix").collect()] == ["source_id", "good"]


def test_catalog_on_disk(spark, tmp_path):
    for name, layout, rows in (("objects", schemas.OBJECTS, OBJECTS), ("columns", schemas.COLUMNS, COLUMNS),
                               ("meta", schemas.META_KV, META), ("nodes", schemas.NODES, NODES)):
        spark.createDataFrame(rows, layout).write.parquet(f"{tmp_path}/{name}")
    catalog = load_object_catalog(spark, str(tmp_path))
    assert catalog.objects.count() == len(OBJECTS)
    assert catalog.nodes.filter(F.size("node") == 3).count() == 6
