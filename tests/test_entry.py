"""The driver contract imports anywhere, and session defaults yield to submitted settings."""
import subprocess
import sys
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_import_without_jar_access(monkeypatch):
    def refuse(*a, **k):
        raise OSError("no archive access")
    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    code = ("import zipfile\n"
            "def refuse(*a, **k): raise OSError('no archive access')\n"
            "zipfile.ZipFile = refuse\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) > 80 and len(e.oracle_sql()) > 80\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_submitted_settings_win():
    code = ("import os\n"
            "os.environ['PYSPARK_SUBMIT_ARGS'] = ('--master local[1] --conf spark.sql.shuffle.partitions=77 '\n"
            "    '--conf spark.sql.adaptive.enabled=false --conf spark.ui.enabled=false pyspark-shell')\n"
            "from talentflow.session import get_spark\n"
            "s = get_spark(extra={'spark.sql.shuffle.partitions': '3'})\n"
            "assert s.conf.get('spark.sql.shuffle.partitions') == '77'\n"
            "assert s.conf.get('spark.sql.adaptive.enabled') == 'false'\n"
            "s.stop()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=180)
