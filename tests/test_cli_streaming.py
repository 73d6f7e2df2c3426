import json

import pytest

from mapweave import Mapping
from mapweave.__main__ import main
from mapweave.queries import document
from mapweave.sources import io
from mapweave.streaming.run import write_stream

CONFIG = document({"m": "$VARIABLES.m", "t": "$INPUT.t", "none": "$VARIABLES.none"}, {"m": {"type": "string", "default": "hi"}, "none": {"type": "string"}, "n": {"type": "integer", "required": True}}, inputs={"t": {"type": "string", "required": True}}, other="$VARIABLES.n")


@pytest.fixture
def files(tmp_path):
    for name, value in (("config", CONFIG), ("bad", {}), ("input", {"t": "T"}), ("payload", {"n": 3, "extra": True})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "null.json").write_text("null")
    (tmp_path / "list.json").write_text("[]")
    return lambda name: str(tmp_path / name)


def test_run(spark, files, capsys):
    base = ["run", "--config", files("config.json"), "--mapping", "root"]
    assert main([*base, "--input", files("input.json")]) == 0
    assert json.loads(capsys.readouterr().out) == {"m": "hi", "t": "T", "none": None}
    assert main([*base, "--input", files("input.json"), "--payload", files("null.json"), "--output", files("new/dir/out.json"), "--pretty"]) == 0
    assert json.loads(open(files("new/dir/out.json")).read())["m"] == "hi" and "\n" in open(files("new/dir/out.json")).read()
    other = ["run", "--config", files("config.json"), "--mapping", "other"]
    assert main([*other, "--payload", files("payload.json")]) == 0 and capsys.readouterr().out.strip() == "3"
    assert main([*other, "--payload", files("empty.json")]) == 70
    assert main(base) == 70


@pytest.mark.parametrize(
    "args, code",
    [
        ([], 64), (["run"], 64), (["nope"], 64), (["run", "--config"], 64), (["run", "--config", "@config.json"], 64), (["run", "--what", "x"], 64), (["run", "--help"], 0), (["--help"], 0), (["schema", "--help"], 0),
        (["run", "--config", "@bad.json", "--mapping", "root"], 65), (["run", "--config", "@none.json", "--mapping", "root"], 66), (["run", "--config", "@config.json", "--mapping", "root", "--payload", "@none.json"], 66),
        (["run", "--config", "@config.json", "--mapping", "missing"], 70), (["run", "--config", "@config.json", "--mapping", "other", "--payload", "@list.json"], 74),
        (["schema"], 64), (["schema", "--config", "@none.json"], 66), (["schema", "--config", "@bad.json"], 70), (["schema", "--config", "@config.json", "--pretty", "--output", "@s.json"], 0),
    ],
)
def test_exit_codes(spark, files, args, code):
    assert main([files(a[1:]) if a.startswith("@") else a for a in args]) == code


def test_json_lines_source_and_sinks(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"n": 1}\n\n{"n": 2, "m": "x"}\n')
    df = io.json_payloads(spark, str(tmp_path / "in.jsonl"))
    out = Mapping.from_dict(CONFIG).to_json_df(df, inputs={"t": "T"}, payload="payload", keep=[])
    for fmt in ("text", "json", "parquet"):
        io.write_lines(out, str(tmp_path / fmt), fmt)
        io.write_lines(out, str(tmp_path / fmt), fmt)
    assert sorted(json.loads(r.value)["m"] for r in spark.read.text(str(tmp_path / "text")).collect()) == ["hi", "hi", "x"]
    assert io.read_bytes("file://" + str(tmp_path / "in.jsonl")).startswith(b"{")


def test_stream(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(k, None if k % 4 == 0 else k) for k in range(20)], "id long, n long").write.parquet(source)
    stream = spark.readStream.schema("id long, n long").parquet(source)
    m = Mapping.from_dict(CONFIG)
    q = write_stream(m, stream, str(tmp_path / "good"), str(tmp_path / "c1"), str(tmp_path / "bad"), mapping="other", keep=["id"])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 15 and spark.read.parquet(str(tmp_path / "bad")).filter("_diagnostics[0].code = 'VARIABLE_REQUIRED'").count() == 5
    q = write_stream(m, stream.filter("n is not null"), str(tmp_path / "all"), str(tmp_path / "c2"), mapping="other", keep=["id"])
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 15
