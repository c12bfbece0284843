import json
import logging

import pytest

from codeloom.cli import log_to, parser, run
from codeloom.plans import replies


def test_commands(spark, tmp_path):
    (tmp_path / "index.js").write_text("import './a.js'\nfunction loadFile() {}\n")
    (tmp_path / "a.js").write_text("export default 1\nclass A { run() {} }\nclass B { run() {} loadFiles() {} }\n")
    (tmp_path / "dead.js").write_text("export default 2\n")
    at = lambda *argv: run(parser().parse_args(list(argv)), spark)
    folder = str(tmp_path)
    text, passed = at("report", folder)
    assert "- Unreached files: 1" in text and not passed
    assert "- Files: 3" in at("analyze", folder)[0]
    assert not at("dead-code", folder)[1] and "- ./dead.js" in at("isolated", folder)[0]
    assert "- Files: 3" in at("health", folder)[0]
    text, passed = at("duplicates", folder, "--similar", "0.8")
    assert "### run: 2 places, cross-class" in text and "### loadFile and loadFiles: 89% alike" in text and not passed
    assert json.loads(at("duplicates", folder, "--format", "json")[0])["duplicates"][0]["count"] == 2
    assert "`./a.js` (Medium): 1 dependents" in at("hubs", folder, "--threshold", "1")[0]
    assert "- Methods: 3" in at("functions", folder)[0]
    assert at("analyze", folder, "--format", "ntriples", "--output", str(tmp_path / "nt"))[1] and list((tmp_path / "nt").glob("part-*"))
    log = tmp_path / "log.txt"
    log_to(str(log), most_bytes=200, kept=2)
    for k in range(20):
        logging.getLogger("codeloom").info("message %d", k)
    assert "message 19" in log.read_text() and len(list(tmp_path.glob("log.txt*"))) == 3


def test_tools_take_their_arguments_only(spark, tmp_path):
    assert [t["name"] for t in replies.schemas()] == ["analyze", "dead_code", "health", "isolated", "hubs", "functions", "duplicates"]
    for tool, given in [("none", {}), ("hubs", {}), ("hubs", {"directory": ".", "limit": "x"}), ("hubs", {"directory": ".", "wrong": 1}), ("dead_code", {"directory": ".", "format": "xml"})]:
        with pytest.raises(ValueError):
            replies.answer(spark, tool, **given)
    with pytest.raises(FileNotFoundError):
        replies.answer(spark, "health", directory=str(tmp_path / "none"))
