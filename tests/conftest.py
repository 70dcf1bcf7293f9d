import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rowkin.session import session, ship_package

    s = session(4, 4, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    ship_package(s)
    return s
