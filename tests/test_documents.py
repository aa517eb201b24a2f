"""Single JSON documents read in byte ranges against the standard library."""

import json
import random

import pytest

from stopflow.sources.documents import read_records
from stopflow.sources.readers import read_lines, read_polygons, read_weather
from stopflow.sources.writers import write_collections, write_documents


@pytest.fixture
def small_ranges(spark):
    """Ranges of 16 KB, so that a document of some hundred KB lies in many."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "16384")
    yield
    for name in names:
        spark.conf.unset(name)


def records(rng, n):
    nasty = ['a } b', '{"x": [', '\\"', "\\\\", "}}}]]", "é}ü{", "", 'quote " and \\ slash }']
    out = []
    for i in range(n):
        out.append(
            {
                "id": i,
                "note": rng.choice(nasty) * rng.randrange(1, 4),
                "nested": {"list": [{"k": rng.choice(nasty)}, [1, [2, {}]]] * rng.randrange(3)},
                "long": "x" * (20_000 if i % 97 == 5 else rng.randrange(200)),
            }
        )
    return out


def test_elements_that_are_arrays_over_many_ranges(spark, tmp_path, small_ranges):
    rows = []
    for i in range(40):
        rows += [[{"in": "}"}, [{"x": "y" * 50}] * 100], {"id": i}, {"long": [{"z": 1}] * (i * 20)}, i, None]
    (tmp_path / "doc.json").write_text(json.dumps(rows))
    assert got(read_records(spark, str(tmp_path))) == wanted([r for r in rows if isinstance(r, dict)])
    doc = {"box": [[[{"no": 1}] * 900]], "features": rows, "more": {"a": {"b": [{"no": 2}] * 900}}}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    assert got(read_records(spark, str(tmp_path), "features")) == wanted([r for r in rows if isinstance(r, dict)])


def got(df):
    return sorted((json.loads(r.value) for r in df.collect()), key=lambda v: json.dumps(v, sort_keys=True))


def wanted(rows):
    return sorted(rows, key=lambda v: json.dumps(v, sort_keys=True))


@pytest.mark.parametrize("indent, ascii_only", [(None, False), (1, True)])
def test_array_document_in_many_ranges(spark, tmp_path, small_ranges, indent, ascii_only):
    rows = records(random.Random(1), 200)
    path = tmp_path / "one.json"
    path.write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only))
    df = read_records(spark, str(path))
    assert got(df) == wanted(rows)
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4


def test_member_array_among_other_members(spark, tmp_path, small_ranges):
    rows = records(random.Random(2), 150)
    doc = {
        "type": "FeatureCollection",
        "crs": {"type": "name", "properties": {"name": "a}"}, "features": [{"no": 1}]},
        "before": records(random.Random(3), 60),
        "features": rows,
        "after": [{"id": -1, "features": [{"no": 2}]}] * 200,
        "not features": [{"no": 3}],
    }
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=False) + "\n")
    assert got(read_records(spark, str(tmp_path), "features")) == wanted(rows * 2)
    assert read_records(spark, str(tmp_path), "missing").count() == 0
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path), "a}b")


@pytest.mark.parametrize(
    "text, rows",
    [
        ("[]", []), ("  [ {} ]\n", [{}]), ("{}", [{}]), ('{"a": {"b": [1]}}\n\n', [{"a": {"b": [1]}}]),
        ('[1, "}", null, [{"in": 1}], {"a": 1}]', [{"a": 1}]), ('[{"a": 1}, {"b": "cut', [{"a": 1}]), ("", []),
    ],
)
def test_small_documents(spark, tmp_path, text, rows):
    (tmp_path / "doc.json").write_text(text)
    assert got(read_records(spark, str(tmp_path))) == wanted(rows)


def test_record_over_many_ranges(spark, tmp_path, small_ranges):
    rows = [{"a": 1}, {"deep": [{"k": "} {"}] * 20_000}, {"b": "}" * 50_000}, {"c": 3}]
    (tmp_path / "doc.json").write_text(json.dumps(rows))
    assert got(read_records(spark, str(tmp_path))) == wanted(rows)


def test_layers_equal_the_form_with_one_feature_a_line(spark, tmp_path, small_ranges):
    rng = random.Random(6)

    def feature(i, kind, coordinates, **more):
        geometry = {"type": kind, "coordinates": coordinates}
        return {"type": "Feature", "properties": {"GEOID": f"t}}{i}", "XDSegID": str(i), **more}, "geometry": geometry}

    def ring(n):
        return [[rng.uniform(-90, 90), rng.uniform(-40, 40)] for _ in range(n)]

    tracts = [
        feature(i, "Polygon", [ring(rng.randrange(4, 200)), ring(4)], white_pct=i)
        if i % 3
        else feature(i, "MultiPolygon", [[ring(5)], [ring(300)]], NAME='x, County {"y"}, Z')
        for i in range(200)
    ]
    roads = [feature(i, "LineString", ring(rng.randrange(2, 100))) for i in range(200)]
    for name, features in (("tracts", tracts), ("roads", roads)):
        (tmp_path / f"{name}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        lines = (json.dumps({"type": "FeatureCollection", "features": [f]}) for f in features)
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    for read, name in ((read_polygons, "tracts"), (read_lines, "roads")):
        whole = read(spark, str(tmp_path / f"{name}.geojson"))
        lines = read(spark, str(tmp_path / f"{name}.jsonl"), multi_line=False)
        assert whole.schema == lines.schema
        assert sorted(map(str, whole.collect())) == sorted(map(str, lines.collect()))
        assert whole.count() == 200


def test_weather_array(spark, tmp_path, small_ranges):
    rows = [{"temperature": i / 7, "icon": "}", "other": {"x": [i]}} for i in range(500)]
    (tmp_path / "w.json").write_text(json.dumps(rows))
    (tmp_path / "w.jsonl").write_text("\n".join(map(json.dumps, rows)))
    whole = read_weather(spark, str(tmp_path / "w.json"), multi_line=True)
    lines = read_weather(spark, str(tmp_path / "w.jsonl"))
    assert whole.schema == lines.schema and whole.count() == 500
    assert sorted(map(str, whole.collect())) == sorted(map(str, lines.collect()))


def test_written_documents_are_read_back(spark, tmp_path):
    rows = records(random.Random(7), 60)
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    write_documents(df, str(tmp_path / "arrays"), 3)
    files = list((tmp_path / "arrays").glob("document=*/*.txt"))
    assert len(files) == 3 and sum(len(json.loads(f.read_text())) for f in files) == 60
    assert got(read_records(spark, str(tmp_path / "arrays"))) == wanted(rows)
    write_collections(df, str(tmp_path / "layers"), 2)
    docs = [json.loads(f.read_text()) for f in (tmp_path / "layers").glob("document=*/*.txt")]
    assert wanted(r for d in docs for r in d["features"]) == wanted(rows)
    assert got(read_records(spark, str(tmp_path / "layers"), "features")) == wanted(rows)
