"""Training-data operators: quality, deduplication, secrets, privacy, mixing, packing, search.

Nothing else in the library imports this subpackage.  Shared conventions:

* Every operator takes DataFrames and column names, selects the columns it needs before doing
  anything else (extra or clashing columns are therefore harmless) and returns a DataFrame.
* Null text counts as empty text unless an operator says otherwise.
* Intermediate tables go to the folder named by ``spark.checkpoint.dir`` (see ``shared.cut``).
"""
