import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from riskloom.session import build_session
    s = build_session("local[4]", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="riskloom-test-ckpt-")})
    yield s


@pytest.fixture(scope="session")
def make_files(spark):
    """code_files rows for one or more repositories: {repo: {path: content}}."""
    from riskloom.sources.files import CODE_FILES_SCHEMA

    def build(repos):
        rows = []
        for repo, files in repos.items():
            for path, content in files.items():
                rows.append((repo, "sha-" + repo, path, content, len(content.encode("utf-8"))))
        return spark.createDataFrame(rows, CODE_FILES_SCHEMA)
    return build
