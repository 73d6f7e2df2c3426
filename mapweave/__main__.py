"""Command line: `python -m mapweave run ...` and `python -m mapweave schema ...`."""

from __future__ import annotations

import json
import os
import sys

from mapweave.errors import ConfigValidationError, MappingError
from mapweave.schema.generator import generate_json_schema
from mapweave.sources import io

OK, USAGE, CONFIG, NO_FILE, FAILED, IO = 0, 64, 65, 66, 70, 74
_RUN = "usage: python -m mapweave run --config FILE --mapping NAME [--input FILE] [--payload FILE] [--output FILE] [--pretty] [--help]"
_SCHEMA = "usage: python -m mapweave schema --config FILE [--output FILE] [--pretty] [--help]"


class _Usage(Exception):
    pass


def _options(args: list[str], valued: tuple[str, ...], needed: tuple[str, ...]) -> dict:
    found: dict = {}
    rest = list(args)
    while rest:
        name = rest.pop(0)
        if name in ("--pretty", "--help", "-h"):
            found[name.strip("-")[0:6]] = True
        elif name in valued:
            if not rest or rest[0].startswith("--"):
                raise _Usage(f"{name} needs a value")
            found[name[2:]] = rest.pop(0)
        else:
            raise _Usage(f"unknown option {name}")
    if not (found.get("help") or found.get("h")):
        for name in needed:
            if name[2:] not in found:
                raise _Usage(f"{name} is required")
    return found


def _object(path: str | None) -> dict:
    if path is None:
        return {}
    text = io.read_bytes(path)
    value = json.loads(text) if text.strip() else {}
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ValueError(f"{path} must hold an object")
    return value


def _emit(text: str, path: str | None) -> None:
    if path:
        io.write_document(text, path)
    else:
        print(text)


def _run(o: dict) -> None:
    from pyspark.sql import SparkSession

    from mapweave.plans.mapping import Mapping

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    mapping = Mapping.from_path(o["config"])
    df = io.one_payload(spark, json.dumps(_object(o.get("payload"))))
    out = mapping.to_json_df(df, o["mapping"], _object(o.get("input")), payload="payload", validate=False, on_error="quarantine", pretty="pretty" in o).first()
    if out["_diagnostics"]:
        d = out["_diagnostics"][0]
        raise MappingError(d.code, d.message, d.pointer, d.details)
    _emit(out["output"], o.get("output"))


def main(argv: list[str]) -> int:
    say = lambda text: print(text, file=sys.stderr)
    if not argv or argv[0] not in ("run", "schema"):
        say(f"{_RUN}\n{_SCHEMA}")
        return OK if argv and argv[0] in ("--help", "-h") else USAGE
    run, usage = argv[0] == "run", _RUN if argv[0] == "run" else _SCHEMA
    try:
        if len(argv) == 1:
            raise _Usage("no options")
        o = _options(argv[1:], ("--config", "--mapping", "--input", "--payload", "--output") if run else ("--config", "--output"), ("--config", "--mapping") if run else ("--config",))
        if "help" in o or "h" in o:
            print(usage)
            return OK
        for name in ("config", "input", "payload"):
            if name in o and not os.path.isfile(o[name]):
                say(f"no such file: {o[name]}")
                return NO_FILE
        if run:
            _run(o)
        else:
            _emit(json.dumps(generate_json_schema(io.read_bytes(o["config"])), indent=2 if "pretty" in o else None, ensure_ascii=False, default=float), o.get("output"))
        return OK
    except _Usage as e:
        say(f"{e}\n{usage}")
        return USAGE
    except ConfigValidationError as e:
        say(f"invalid configuration: {e}")
        return CONFIG if run else FAILED
    except MappingError as e:
        say(str(e))
        return FAILED
    except OSError as e:
        say(f"I/O error: {e}")
        return IO
    except ValueError as e:
        say(f"I/O error: {e}")
        return IO
    except Exception as e:  # noqa: BLE001
        say(f"unexpected error: {e}")
        return FAILED


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
