"""Operators that prepare language-model training data.

Nothing else in the library imports this subpackage; its queries are in
:mod:`tidemark.llm.queries`.  Executors need the package on their path
(``--py-files`` or an installed wheel), as the Arrow functions are pickled by
reference.
"""
