"""The driver contract holds where optional packages are missing."""

import subprocess
import sys

CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r}:
            raise ImportError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
found = entry.queries()
print(len(found), sum(n.startswith("op") and "_" in n and n[2].isdigit() for n in found), "pipeline" in found)
assert set(entry.oracle_sql()) <= set(found)
"""


def counts(*names):
    code = CODE.replace("{names!r}", repr(set(names) or {"-"}))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], capture_output=True, text=True, check=True)
    return done.stdout.split()


def test_other_queries_stay_where_a_package_is_missing():
    whole = counts()
    for name in ("xxhash", "public_tokenizers"):
        n, ops, pipeline = counts(name)
        assert ops == "0" and pipeline == "False"
        assert int(n) == int(whole[0]) - int(whole[1]) - (whole[2] == "True") > 100
