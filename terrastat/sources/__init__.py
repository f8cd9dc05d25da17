from .delimited import NULL_TOKENS, read_delimited
from .literal import literal_table
from .model_store import MODEL_SCHEMAS, load_model, save_model, versions
from .shared import shared_folder, stage
from .workbooks import WorkbookSource, read_workbooks, sheet_columns

__all__ = [
    "MODEL_SCHEMAS",
    "NULL_TOKENS",
    "WorkbookSource",
    "literal_table",
    "load_model",
    "read_delimited",
    "read_workbooks",
    "save_model",
    "shared_folder",
    "sheet_columns",
    "stage",
    "versions",
]
