from codecairn.cli import main

raise SystemExit(main())
