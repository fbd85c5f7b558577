"""The driver's entry without what the corpus operators need."""

import subprocess
import sys
from pathlib import Path

from stoplake.plans import registry

ROOT = Path(__file__).resolve().parents[1]


def test_domain_queries_do_without_the_corpus_operators():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    queries, sql = said.stdout.split("\n")[:2]
    assert queries.split() == sql.split() == sorted(registry.queries()) and "without stoplake.llm" in said.stderr
