"""The registry, and that the library stands without its optional subpackage."""

import os
import shutil
import subprocess
import sys

from assayer import registry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_and_oracles():
    queries, oracles = registry.queries(), registry.oracle_sql()
    assert len(queries) > 170 and set(oracles) <= set(queries)
    without = {"sc19_oci", "sc19_rank", "ga_compression", "ta_seed_matches", "ta_islands"}
    without |= {"ta_greedy", "ml_svm_margins", "ml_svm_answers", "ml_svm_scores", "ga_tfidf_svm", "ml_trees_cv", "ppm_pair_probability", "ga_unmasking"}  # walks and fits
    without |= {"tx_meteor", "tp_mixtures", "tp_cosine", "pt_masked", "st_run_measures", "rs_strategies", "txt_locate_near"}  # searches, keyed hashes, files
    assert set(queries) - set(oracles) == without


def test_entry_without_the_optional_subpackage(tmp_path):
    shutil.copytree(f"{REPO}/assayer", tmp_path / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'av_auc' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
