"""mise: restaurant costing and inventory analytics as Spark DataFrame jobs.

Every operator is a function DataFrame(s) -> DataFrame; nothing is collected to
the driver. Sub-packages:

* ``sources``   - adapters over the test tables, loaders, parsers, sinks
* ``functions`` - scalar rules as Column builders
* ``operators`` - costing, inventory, sales, demand, projections, prices, catalog, mutations
* ``plans``     - the registered queries and their SQL oracles
* ``streaming`` - Structured Streaming jobs for the ticket feed
"""

__all__ = ["session"]
