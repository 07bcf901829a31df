"""Where the driver's tables lie. A module of its own, as each test folder has a ``conftest``."""

SF0001 = "/root/testdata/sf0.001"
