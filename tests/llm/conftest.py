import importlib.util
import os
import sys

# The helper module of this folder, under a name of its own.
_path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "odd.py")
_spec = importlib.util.spec_from_file_location("llm_odd", _path)
_module = importlib.util.module_from_spec(_spec)
sys.modules["llm_odd"] = _module
_spec.loader.exec_module(_module)
