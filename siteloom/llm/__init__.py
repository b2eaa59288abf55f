"""Operators for preparing training corpora, each a DataFrame-to-DataFrame job.

Nothing outside this subpackage imports it.  The thin query functions are in
:mod:`siteloom.llm.queries`, the operators in one module each.
"""
