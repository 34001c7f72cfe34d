"""Training-data operators for very large text corpora.

Ten operators, one module each (``op01_...`` to ``op10_...``), on top of

* ``common``     - scratch tables in the shared checkpoint folder, row keys;
* ``textkernel`` - vectorised word splitting and hashing over Arrow buffers;
* ``components`` - distributed connected components;
* ``registry``   - the ``opN_<name>`` queries and their SQL.

Nothing outside this folder imports it except the guarded hook of
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
