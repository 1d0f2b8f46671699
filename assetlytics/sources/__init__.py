from .asset import ASSET_SQL, asset_view, load_asset, materialize_asset  # noqa: F401
from .tables import TABLES, read_table, table_path  # noqa: F401
