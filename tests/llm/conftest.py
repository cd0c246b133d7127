import pytest

pytest.importorskip("cellweft.llm")
