"""The entry module without the optional corpus part."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), len([n for n in e.queries() if n.startswith("op") or n == "pipeline"]), len(e.oracle_sql()) > 0)
"""


def known(missing):
    root = Path(__file__).parents[1]
    done = subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=root, capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_other_queries_stay_when_the_corpus_part_cannot_be_imported():
    for missing in ("svmflow.llm", "corpus_pipeline", "zstandard"):
        n, corpus, oracles = known(missing)
        assert int(n) >= 50 and corpus == "0" and oracles == "True"
