import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for path in [*ROOT.glob("quillgraph/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.parts:
            assert not re.search(r"quillgraph\.llm|from \.+llm|import corpus_pipeline", path.read_text()), path


def test_no_local_checkpoint():
    assert not [p for p in ROOT.glob("quillgraph/**/*.py") if "localCheckpoint(" in p.read_text()]
