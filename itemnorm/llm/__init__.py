"""Operators for preparing training text from item records; nothing else in the library imports them.

The text operators read memory points (`item_id`, `text`) and items (`item_idx`, `item`), the vector operators items (`item_idx`,
`vec_local`) and points (`item_id`, `cluster_name`, `vec_local`), chats are messages of model requests (`request_id`,
`role`, `content`), the mix reads rows with a `source`. Columns that an
operator does not name are ignored, so extra columns of any name cannot clash.
"""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors whole, so these need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
